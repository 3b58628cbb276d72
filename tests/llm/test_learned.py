"""Operators that learn: rules, classifier, languages and secrets."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ripplework.llm import langid, quality, queries, rules, secrets, stats

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 0.0, True) for i, t, lang in rows], DOCS)


def brute_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    marked = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            marked.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n")]
    dup = sum(1 for k, x in enumerate(lines) if WORD.search(x) and x in lines[:k])
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(marked)


def test_base_counts():
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice(["a ", "b ", "c\n", "a b c d e ", "## ", "\n", "é\x85 ", "\x0b"]) for _ in range(r.randint(0, 40)))
        assert stats.measure(text)[:5] == brute_counts(text)
    assert stats.measure(None)[:5] == stats.measure("")[:5] == (0,) * 5


def test_letters_are_those_of_the_pattern():
    every = "".join(chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000)
    for at in range(0, len(every), 997):
        part = every[at : at + 997]
        assert stats.count_letters(part) == len(stats._LETTER.findall(part))
    assert stats.count_letters("") == 0


@pytest.mark.parametrize("name", ["op5_quality", "op8_langid", "op9_rules", "op6_secrets"])
def test_whole_tables(spark, sf, name):
    out = queries.QUERIES[name](spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_rules_learn_and_keep_clean(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in queries.op9_rules(spark, d).collect() if r.doc_id in labels]
    assert any(r.rule > 0 for r in rows)
    bad = [r for r in rows if labels[r.doc_id] == 0]
    clean = [r for r in rows if labels[r.doc_id] == 1 and not r.base_failed]
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)
    assert sum(not r.kept for r in clean) <= 0.02 * len(clean)


def test_rules_hold_on_labels_they_did_not_see(spark):
    d = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    documents = documents.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    half = labels.where("crc32(cast(doc_id as string)) % 2 = 0")
    out = {r.doc_id: r for r in rules.rule_table(documents, half).collect()}
    unseen = [(r.quality, out[r.doc_id]) for r in labels.where("crc32(cast(doc_id as string)) % 2 = 1 AND quality IS NOT NULL").collect() if r.doc_id in out]
    bad = [x for q, x in unseen if q == 0]
    clean = [x for q, x in unseen if q == 1 and not x.base_failed]
    assert sum(not x.kept for x in bad) >= 0.97 * len(bad) > 0 and sum(not x.kept for x in clean) <= 0.01 * len(clean)


def test_sample_of_labels_is_bounded(spark):
    y = spark.range(20_000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality").union(spark.sql("SELECT 5L, 1")).union(spark.sql("SELECT CAST(NULL AS LONG), 1"))
    n = rules.sample_labels(y, 1000).count()
    assert 850 <= n <= 1150 and rules.sample_labels(y, 50_000).count() == 20_000


CLASH = "doc_id long, text string, __stats int, n_words string, __doc int, kept boolean, __row int, node long, root string"


def test_clashing_columns_keep_their_values(spark):
    from ripplework.llm import simhash

    text = "Some ordinary words that make a sentence, and then some more of them; this is a clean text."
    rows = [(k, f"{text} {k}", 7, "n", 8, True, -k, 5, "r") for k in range(12)]
    d = spark.createDataFrame(rows, CLASH)
    y = spark.createDataFrame([(k, 1) for k in range(12)], "doc_id long, quality int")
    assert sorted(map(tuple, rules.keep_documents(d, y).collect())) == rows
    assert sorted(map(tuple, secrets.mask_documents(d).collect())) == rows
    assert set(map(tuple, simhash.dedup_documents(d).collect())) <= set(rows)


def test_rule_list_order_and_verdict(spark):
    x = np.array([[0.0, 5], [1, 5], [2, 1], [3, 0]] * 60)
    bad = (x[:, 0] >= 2) & (x[:, 1] < 1)
    learned = rules.learn(x, bad, np.arange(len(x)) % 3 == 0, ("a", "b"))
    assert learned and (sum(rules.covers(r, x, ("a", "b")) for r in learned) > 0).tolist() == bad.tolist()
    df = spark.createDataFrame([(0.0, 5.0), (3.0, 0.0)], "a double, b double")
    assert [r[0] > 0 for r in df.select(rules.verdict(learned)).collect()] == [False, True]
    assert rules.learn(x, np.zeros(len(x), bool), np.arange(len(x)) % 3 == 0, ("a", "b")) == []


NASTY = [(1, None, None), (2, "", "en"), (3, "one", "en"), (None, "two words", None), (3, "one", "en"), (4, "a b c d e " * 9000, "fr")]


def test_rules_and_quality_edges(spark):
    labels = spark.createDataFrame([(1, None), (3, 0), (3, 1), (99, 0), (None, 1)], "doc_id long, quality int")
    none = labels.limit(0)
    d = docs(spark, NASTY)
    for y in (labels, none):
        out = rules.rule_table(d, y).collect()
        assert len(out) == len(NASTY) and {r.doc_id: r.base_failed for r in out}[4]
        assert rules.keep_documents(d, y).columns == d.columns
        q = quality.quality_table(d, y).collect()
        assert len(q) == len(NASTY) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in q)
    assert {r.score for r in quality.quality_table(d, none).collect()} == {0.5}
    assert rules.rule_table(d.limit(0), labels).count() == quality.quality_table(d.limit(0), labels).count() == 0


def test_pipeline_rules_equal_table(spark):
    d = "/root/testdata/sf0.001"
    documents, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    want = {r.doc_id for r in rules.rule_table(documents, labels).where("kept").collect()}
    assert {r.doc_id for r in rules.keep_documents(documents, labels).collect()} == want


def test_isotonic_against_brute_force():
    r = random.Random(3)
    for _ in range(50):
        n = [r.randint(1, 9) for _ in range(12)]
        p = [r.randint(0, k) for k in n]
        at, v = quality.isotonic(np.arange(12.0), np.array(p, float), np.array(n, float))
        assert (np.diff(v) >= 0).all() and (np.diff(at) > 0).all()
        # min-max formula of isotonic regression
        rate = lambda i, j: sum(p[i : j + 1]) / sum(n[i : j + 1])
        best = [max(min(rate(i, j) for j in range(k, 12)) for i in range(k + 1)) for k in range(12)]
        assert sorted(set(np.round(v, 9))) == sorted(set(np.round(best, 9)))


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = queries.op5_quality(spark, d).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)


def test_quality_against_brute_force(spark, sf):
    """Every step anew with plain loops over all rows, but for the random features themselves."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    labels = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        if r.quality is not None:
            labels[r.doc_id] = max(r.quality, labels.get(r.doc_id, 0))
    x = np.array([stats.measure(r.text)[len(stats.BASE) :] for r in rows])
    m = quality.Model(x.mean(0), x.std(0))
    f = m.features(x)
    fold = [zlib.crc32(str(r.doc_id).encode()) % 3 for r in rows]
    fit = [k for k, r in enumerate(rows) if fold[k] == 0 and r.doc_id in labels]
    y = np.array([float(labels[rows[k].doc_id] > 0) for k in fit])
    beta = np.linalg.solve(sum(np.outer(f[k], f[k]) for k in fit) + quality.RIDGE * np.eye(f.shape[1]), sum(v * f[k] for k, v in zip(fit, y)))
    bins = {}
    for k, r in enumerate(rows):
        if fold[k] == 2 and r.doc_id in labels:
            bins.setdefault(round(min(max(f[k] @ beta * quality.BINS / 2, -quality.BINS), 2 * quality.BINS)), []).append(float(labels[r.doc_id] > 0))
    at = sorted(bins)
    edges, values = quality.isotonic(np.array(at) * 2.0 / quality.BINS, np.array([sum(bins[b]) for b in at]), np.array([len(bins[b]) for b in at], float))
    want = np.interp(f @ beta, edges, values)
    got = {r.doc_id: r.score for r in queries.op5_quality(spark, sf).collect()}
    assert max(abs(got[r.doc_id] - w) for r, w in zip(rows, want)) < 1e-6


def test_normal_equations_sum(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(90, len(stats.RATIOS)))
    y = (x[:, 0] > 0).astype(float)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], [*stats.RATIOS, "__quality"]).repartition(70)
    m = quality.Model(np.zeros(x.shape[1]), np.ones(x.shape[1]))
    xx, xy = quality.normal_equations(df, m)
    f = m.features(x)
    assert np.allclose(xx, f.T @ f) and np.allclose(xy, f.T @ y)


def test_languages(spark):
    d = "/root/testdata/sf0.01"
    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = queries.op8_langid(spark, d).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and want[r.doc_id]]
    assert sum(r.lang_pred == want[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_edges(spark):
    out = {r.doc_id: r.lang_pred for r in langid.language_table(docs(spark, [*NASTY, (7, "123 !?", "en")])).collect()}
    assert out[1] == out[2] == out[7] == "und" and out[3] in ("en", "fr")
    assert {r.lang_pred for r in langid.language_table(docs(spark, [(1, "abc", None)])).collect()} == {"und"}
    assert langid.language_table(docs(spark, [])).count() == 0


def test_every_language_is_learned(spark):
    train = [(k, t, lang) for k, (t, lang) in enumerate([("the quick brown fox", "en"), ("der schnelle braune Fuchs", "de"), ("x", "one")] * 12)]
    train = [x for x in train if zlib.crc32(str(x[0]).encode()) % 4 != 2][:6]
    held = [k for k in range(100, 200) if zlib.crc32(str(k).encode()) % 4 == 2][:3]
    rows = train + [(k, t, None) for k, t in zip(held, ["braune Fuchs", "brown fox", "x"])]
    assert {x[2] for x in train} == {"en", "de", "one"}
    out = {r.doc_id: r.lang_pred for r in langid.language_table(docs(spark, rows)).collect()}
    assert [out[k] for k in held] == ["de", "en", "one"]


def brute_grams(text):
    words = ["".join(c for c in w) for w in re.sub(r"[\W\d_]+", " ", f" {text} ".lower()).split()]
    line = f" {' '.join(words)} " if words else " "
    return [line[k : k + 4] for k in range(len(line) - 3)] + [w for w in words if len(w) == 1]


def test_languages_against_plain_sets(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    has = {}
    for r in rows:
        if r.lang and r.text and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            has.setdefault(r.lang, []).extend(brute_grams(r.text))
    has = {lang: {g for g in set(x) if x.count(g) >= len(x) * langid.SHARE} if len(x) * langid.SHARE > 1 else set(x) for lang, x in has.items()}
    same = 0
    got = {r.doc_id: r for r in queries.op8_langid(spark, sf).collect()}
    for r in rows:
        grams = brute_grams(r.text or "")
        hits = {lang: sum(g in x for g in grams) for lang, x in sorted(has.items())}
        want = max(hits, key=hits.get) if any(c.isalpha() for c in r.text or "") else "und"
        same += got[r.doc_id].lang_pred == want
        if want != "und" and sum(hits.values()):
            assert abs(got[r.doc_id].score - max(hits.values()) / sum(hits.values())) < 0.02
    assert same >= 0.99 * len(rows)


def test_filters_have_no_false_negatives():
    r = np.random.default_rng(1)
    kept = {f"l{k:02d}": r.integers(-(1 << 63), (1 << 63) - 1, 3000) for k in range(11)}
    f = langid.Filters(kept)
    for i, (lang, keys) in enumerate(sorted(kept.items())):
        assert ((f.containing(keys.view(np.uint64))[:, i // 8] >> (i % 8)) & 1).all()
        other = r.integers(-(1 << 63), (1 << 63) - 1, 20_000).view(np.uint64)
        assert ((f.containing(other)[:, i // 8] >> (i % 8)) & 1).mean() <= 2 * f.rate[i] + 1e-3


def brute_base(text):
    out = []
    a = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)"
    out += [(m.start(), 0, m.end()) for m in re.finditer(a, text) if len(m.group(1)) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(out)


def test_secret_spans(spark):
    r = random.Random(2)
    bits = ["password", "PASSWD", "Token", "api_key", "apikey", '"', "'", " = ", ":", "=", "abc", "AKIA", "0123456789abcdef", "ABCDEFGH12345678", "é", "\n", " ", "-x_.", "secret", "Kſ"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(300)] + [None, ""]
    rows = {x.doc_id: x for x in secrets.secret_table(docs(spark, [(k, t, None) for k, t in enumerate(texts)])).collect()}
    for k, t in enumerate(texts):
        base = brute_base(t or "")
        said = ",".join(f"{secrets.KINDS[kind]}:{a}:{b}" for a, kind, b in base)
        assert rows[k].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), t
        assert [rows[k].n_assign, rows[k].n_access, rows[k].n_hex] == [sum(x[1] == i for x in base) for i in range(3)]
        assert [s for s in rows[k].spans.split(",") if s and not s.startswith("markov")] == [s for s in said.split(",") if s]


def test_markov_finds_random_strings(spark):
    r = random.Random(4)
    words = "the quick brown fox jumps over lazy dogs internationalization_of_configuration get_user_account_settings2 some-longer-hyphenated-name-v2".split()
    key = "".join(r.choices(secrets.ALPHABET[:62], k=40)) + "7q"
    rows = [(k, " ".join(r.choices(words, k=60)), None) for k in range(60)] + [(99, f"see {key} here", None)]
    out = {x.doc_id: x.spans for x in secrets.secret_table(docs(spark, rows)).collect()}
    assert out[99] == f"markov:4:{4 + len(key)}" and not any(v for k, v in out.items() if k != 99)


def test_pair_counts_against_brute_force():
    r = random.Random(5)
    for _ in range(60):
        t = "".join(r.choice(["ab", "Z", "9", " ", "é", "-", "token=abcdefghijkl1", "0123456789abcdef"]) for _ in range(r.randint(0, 30)))
        got = np.zeros((2, secrets.SIZE * secrets.SIZE), np.int64)
        secrets.pair_counts(t, got)
        inside = {i for _, _, _, a, b in secrets.base_spans(t) for i in range(a, b)}
        code = [secrets.ALPHABET.find(c) if c in secrets.ALPHABET else secrets.SIZE - 1 for c in t]
        want = np.zeros_like(got)
        for i in range(1, len(t)):
            if code[i] != secrets.SIZE - 1:
                want[int(i in inside), code[i - 1] * secrets.SIZE + code[i]] += 1
        assert (got == want).all(), t


def test_markov_on_texts_it_was_not_trained_on(spark):
    """Random strings put into held-out documents, and these documents without them."""
    r = random.Random(6)
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table = secrets.train(d.where("doc_id % 2 = 0"))
    clean = [x.text for x in d.where("doc_id % 2 = 1").collect() if x.text]
    false = sum(k == 3 for t in clean for _, k, _ in secrets.spans(t, table))
    assert false <= 0.002 * len(clean)
    found = total = 0
    for t in clean[:300]:
        kind = r.choice([secrets.ALPHABET[:62], secrets.ALPHABET, secrets.ALPHABET[26:62], secrets.ALPHABET[:52]])
        key, at = "".join(r.choices(kind, k=r.randint(14, 48))), t.find(" ") + 1
        made = secrets.spans(f"{t[:at]}{key} {t[at:]}", table)
        found += any(a <= at and at + len(key) <= b for a, _, b in made)
        total += 1
    assert found >= 0.97 * total


def test_very_long_text_of_spans():
    table = np.full((secrets.SIZE, secrets.SIZE), 1.0)
    text = "token=abcdefghijklmnop 0123456789abcdef0 qwertyuiopasdfgh " * 40_000
    found = secrets.spans(text, table)
    assert len(found) == 40_000 * 3 and found == sorted(found)


def test_run_beside_a_base_span_is_whole():
    key = "sk_live_0123456789abcdefC39HqLyjWDarjtT1zdp7"
    table = np.ones((secrets.SIZE, secrets.SIZE))
    assert secrets.spans(f"a {key} b", table) == [(2, 3, 2 + len(key)), (10, 2, 26)]
    assert secrets.masked(f"a {key} b", table) == "a [SECRET] b"
    assert secrets.spans("x 0123456789abcdef01234567 y", table) == [(2, 2, 26)]


def test_masking(spark):
    d = docs(spark, [(1, 'x token = "aaaaaaaaaaaaaaaa1" y 0123456789abcdef0 z', None), (2, "clean", None), (3, None, None)])
    out = {r.doc_id: r for r in secrets.mask_documents(d).collect()}
    assert out[1].text == 'x [SECRET]" y [SECRET] z' and out[1].n_chars == len(out[1].text)
    assert out[2].text == "clean" and out[3].text is None and secrets.mask_documents(d).columns == d.columns
    assert secrets.secret_table(d.limit(0)).count() == 0
