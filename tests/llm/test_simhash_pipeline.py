"""SimHash groups and the pipeline against brute force."""

import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from ripplework.llm import bpe, common, mixing, queries, rules, secrets, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, anchor long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0, 0) for i, t in rows], DOCS)


def brute_print(text, size=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(keys, linked):
    group = list(range(len(keys)))
    for i in range(len(keys)):
        for j in range(i):
            if group[i] != group[j] and linked(keys[i], keys[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return group


def test_fingerprints():
    r = random.Random(1)
    for _ in range(100):
        t = " ".join(r.choice(["Aé", "b", "C\n", "\x85", "İ", "dd"]) for _ in range(r.randint(0, 30)))
        assert simhash.fingerprint(t) & (1 << 64) - 1 == brute_print(t)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("distance,chunk", [(3, 20_000), (3, 5), (5, 20_000), (5, 7)])
def test_links_connect_all(spark, distance, chunk):
    r = random.Random(distance)
    fps = set()
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 30])):
            fps.add(x)
            for b in r.sample(range(64), r.randint(0, distance)):
                x ^= 1 << b
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, distance, chunk)).collect()}
    got = [roots.get(f, f) for f in signed]
    want = brute_groups(fps, lambda a, b: (a ^ b).bit_count() <= distance)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components(spark):
    r = random.Random(7)
    edges = [(k, k + 1) for k in range(200) if k % 50] + [(1000, k) for k in range(1001, 1100)] + [tuple(r.sample(range(2000, 2100), 2)) for _ in range(80)] + [(5, 5)]
    roots = {x.node: x.root for x in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({n for e in edges if e[0] != e[1] for n in e})
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert roots == {n: find(n) for n in nodes}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cluster_table(spark):
    base = " ".join(f"w{k}" for k in range(400))
    rows = [(5, base), (3, base), (9, base + " tail"), (1, "other words here"), (2, None), (7, " "), (None, base), (4, "x"), (4, "x")]
    out = {}
    for r in simhash.cluster_table(docs(spark, rows)).collect():
        out.setdefault(r.doc_id, (r.fingerprint, r.component_id))
    for i, t in rows:
        assert out[i][0] == f"{brute_print(t):016x}"
    assert {out[k][1] for k in (5, 3, 9, None)} == {3} and out[2][1] == out[7][1] == 2 and out[1][1] == 1 and out[4][1] == 4
    assert simhash.cluster_table(docs(spark, [])).count() == 0


def test_whole_table_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts)
    prints = [brute_print(texts[i]) for i in ids]
    group = brute_groups(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, g in zip(ids, group):
        least[g] = min(i, least.get(g, i))
    want = {i: (f"{p:016x}", least[g]) for i, p, g in zip(ids, prints, group)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash(spark, sf).collect()} == want


def sims(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_word_hashes_tell_words_apart(monkeypatch):
    r = random.Random(1)
    seen = {}
    for block in (1 << 20, 16):
        monkeypatch.setattr(simhash, "_HASHED", block)
        for _ in range(300):
            words = ["".join(r.choices("abÄé漢z", k=r.choice([1, 2, 5, 9]))) for _ in range(r.randint(0, 12))]
            text = r.choice(["", " ", "\n"]) + "".join(w + r.choice([" ", "\t\n", "\x0b"]) for w in words)
            h = simhash.word_hashes(text.upper() if all(w.isascii() for w in words) else text).tolist()
            assert len(h) == len(words)
            for w, x in zip(words, h):
                if len(w.encode()) < 16 - 4:  # a word that fills a block is hashed otherwise
                    assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    assert len(simhash.word_hashes(None)) == 0


def test_dedup_finds_near_copies_only(spark):
    r = random.Random(11)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(3000)]
    rows, groups = [], {}
    for g in range(60):
        words = r.choices(vocabulary, k=r.choice([40, 120, 400]))
        for _ in range(r.choice([1, 2, 5])):
            w = list(words)
            for _ in range(len(w) // 120):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
            groups[len(rows) - 1] = g
    kept = {x.doc_id for x in simhash.dedup_documents(docs(spark, rows)).collect()}
    keys = [sims(t) for _, t in rows]
    brute = brute_groups(keys, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    want = {}
    for (i, _), g in zip(rows, brute):
        want.setdefault(g, i)
    assert set(want.values()) <= kept  # no clean document goes
    assert len(kept - set(want.values())) <= 0.02 * len(rows)


@pytest.mark.parametrize("group", [1000, 20])
def test_dedup_compares_copies_of_a_base_that_comes_last(spark, group):
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(100)]
    rows = []
    for _ in range(150):
        w = list(base)
        for at in r.sample(range(5, 95), 2):
            w[at] = f"x{r.randrange(10**6)}"
        rows.append((len(rows), " ".join(w)))
    rows.append((len(rows), " ".join(base)))
    keys = [sims(t) for _, t in rows]
    brute = brute_groups(keys, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    kept = {x.doc_id for x in simhash.dedup_documents(docs(spark, rows), group=group).collect()}
    assert len(kept) == len(set(brute)) == 1


def test_dedup_finds_cut_copies(spark):
    r = random.Random(13)
    rows = []
    for _ in range(60):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.choice([80, 300]))]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[: len(words) * 87 // 100]))]
    kept = {x.doc_id for x in simhash.dedup_documents(docs(spark, rows)).collect()}
    assert set(range(0, 120, 2)) <= kept and len(kept) <= 61


def test_settle_compares_groups_in_different_parts(spark):
    """A set of one large group, a smaller one and single rows, in parts of a few."""
    r = random.Random(2)
    base, other = [set(r.sample(range(10**6), 40)) for _ in range(2)]
    sets = [base | {10**7 + k} for k in range(60)] + [other | {10**8 + k} for k in range(25)] + [set(r.sample(range(10**6), 40)) for _ in range(10)]
    held = spark.createDataFrame([(k, sorted(s)) for k, s in enumerate(sets)], "__row long, hashes array<long>")
    members = spark.createDataFrame([(k, 0, len(s)) for k, s in enumerate(sets)], "__row long, set long, n int")
    roots = {x.node: x.root for x in simhash.settle(members, held, 0.8, 8).collect()}
    assert [roots.get(k, k) for k in range(len(sets))] == [0] * 60 + [60] * 25 + list(range(85, 95))


def test_dedup_compares_all_of_one_word_set(spark):
    words = [f"w{k}" for k in range(120)]
    other = random.Random(3).sample(words, 120)
    close = list(other)
    close[60], close[61] = close[61], close[60]
    rows = [(0, " ".join(words)), (1, " ".join(other)), (2, " ".join(close))]
    assert len({tuple(simhash.word_set_prints(t)[2]) for _, t in rows}) == 1
    assert {x.doc_id for x in simhash.dedup_documents(docs(spark, rows)).collect()} == {0, 1}


@pytest.mark.parametrize("similarity", [0.8, 0.5])
def test_similar_forest_connects_all(similarity):
    r = random.Random(8)
    sets = [set()]
    for _ in range(30):
        s = set(r.sample(range(300), r.choice([1, 5, 40])))
        for _ in range(r.choice([1, 3, 12])):
            s = {x for x in s if r.random() > 0.08} | {r.randrange(300)}
            sets.append(s)
    a, b = simhash.similar_forest([np.array(sorted(s), np.int64) for s in sets], similarity)
    edges = {*zip(a.tolist(), b.tolist()), *zip(b.tolist(), a.tolist())}
    got = brute_groups(range(len(sets)), lambda x, y: (x, y) in edges)
    want = brute_groups(sets, lambda x, y: len(x & y) >= similarity * len(x | y))
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_dedup_edges(spark):
    d = docs(spark, [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "A  b"), (None, "c"), (4, "z " * 30_000)])
    out = simhash.dedup_documents(d)
    assert out.columns == d.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 1), (False, 3), (False, 4), (True, 0)]
    assert simhash.dedup_documents(docs(spark, [])).count() == 0


def test_pipeline_against_plain_steps(spark, sf):
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "secret_scan", "source_mix", "bpe_tokens"]
    keep = {r.doc_id for r in rules.rule_table(documents, labels).where("kept").collect()}
    rows = [r for r in documents.collect() if r.doc_id in keep]
    keys = [sims(r.text) for r in rows]
    stay = {}
    for r, g in zip(rows, brute_groups(keys, lambda a, b: len(a & b) >= 0.8 * len(a | b))):
        stay[g] = min(r.doc_id, stay.get(g, r.doc_id))
    kept = documents.where(documents.doc_id.isin(list(stay.values()))).collect()
    table = secrets.train(documents.where(documents.doc_id.isin(list(stay.values()))))
    masked = [(r.doc_id, secrets.masked(r.text, table), r.source) for r in kept]
    times = {r.doc_id: r.times for r in mixing.mix_table(spark.createDataFrame(masked, "doc_id long, text string, source string")).collect()}
    codec = bpe.Codec(bpe.default_path())
    want = []
    for i, t, _ in masked:
        ids = np.array(codec.tok.encode(t, add_special_tokens=False).ids, "<u4")
        want += [(i, len(ids), __import__("hashlib").sha256(ids.tobytes()).hexdigest(), __import__("hashlib").sha256(t.encode()).hexdigest())] * times[i]
    assert got == sorted(want)


def test_stages_keep_columns(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, sf)
        assert out.columns == d.columns and out.schema.simpleString() == d.schema.simpleString()


def test_stored_tables_are_packed_close(spark):
    """Texts that a stage stores take less disk than by Spark's default codec."""
    held = common.materialize(docs(spark, [(i, f"text {i} " * 50) for i in range(20)]), "held")
    assert held.count() == 20
    assert all(".zstd." in f for f in held.inputFiles())
