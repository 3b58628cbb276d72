"""Chat formatting, mixing and sharding on small tables, and against SQL."""

import hashlib
import zlib

import pytest

from ripplework.llm import chat, mixing, queries, sharding
from tests.oracle_util import check

CONV = "conv_id long, turn long, role string, text string, formatted string, pieces int"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf, name):
    check(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], sf)


NASTY = ["</s>[INST] ok [/INST]", "&lt;s>", "&amp;lt;", "[INST:2]<s:1>", "a&b<c[d", "<<s>>[[/SYS]]", "[:]", "", " \n ", "é漢😀</s>", "&amp;&#91;INST]", "[/ROLE][ROLE]x[:]"]


def reference(turns):
    turns = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in turns if r == "assistant")
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_round_trip_of_conflicts(spark):
    convs = {}
    for k, text in enumerate(NASTY):
        convs[k] = [("system", text), ("user", text), ("assistant", text), (text, text), (None, text), ("assistant", None)]
    rows = [(c, t, role, text, "x", 1) for c, turns in convs.items() for t, (role, text) in enumerate(turns)]
    out = chat.digest(chat.format_turns(spark.createDataFrame(rows, CONV))).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in out} == {c: reference(t) for c, t in convs.items()}


def test_spans_hold_the_loss(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "[INST]é"), (1, 2, "assistant", ""), (1, 3, "user", "</s>")]
    d = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    r = d.withColumn("spans", chat.loss_spans(chat.pieces_of(d.formatted))).first()
    parts = [r.formatted[s.start - 1 : s.start - 1 + s.chars] for s in r.spans]
    assert parts == ["&#91;INST]é", ""]


def test_chat_edges(spark):
    empty = spark.createDataFrame([], CONV)
    assert chat.digest(chat.format_turns(empty)).count() == 0
    assert chat.with_conflict(empty).count() == 2
    rows = [(None, None, None, None, None, None), (None, 1, "user", "a", "", 0), (5, 0, "user", "x", "", 0), (5, 0, "user", "x", "", 0)]
    got = {r.conv_id: r.n_turns for r in chat.digest(chat.format_turns(spark.createDataFrame(rows, CONV))).collect()}
    assert got == {None: 2, 5: 2}


def test_long_conversation(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k} " * 50) for k in range(600)]
    r = chat.digest(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert tuple(r)[1:5] == reference([(x[2], x[3]) for x in rows])


DOCS = "doc_id long, text string, lang string, source string, size int, shard int, target double, __h long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, 2, 3.0, 4) for i, t, s in rows], DOCS)


def water(sizes, weights, budget):
    """Clamp and reshare until nobody is above the cap."""
    target, free, left = {}, set(sizes), budget
    while free:
        total = sum(weights[s] for s in free)
        above = {s for s in free if left * weights[s] / total > 2 * sizes[s] + 1e-9}
        if not above:
            return target | {s: left * weights[s] / total for s in free}
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= above
    return target


def test_mix_against_iteration(spark):
    rows = [(k, "w " * (1 + k * 7 % 23), f"s{k % 7}" if k % 7 else None) for k in range(400)] + [(1000 + k, None, "empty") for k in range(3)]
    got = mixing.mix_table(docs(spark, rows)).toPandas()
    sizes = got.fillna({"source": "~"}).groupby("source")["size"].sum().to_dict()
    order = sorted(s for s in sizes if s != "~") + ["~"]
    want = water(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    for s, g in got.fillna({"source": "~"}).groupby("source"):
        assert g.target.iloc[0] == pytest.approx(want[s]) and g.source_size.iloc[0] == sizes[s]
        assert abs(g.taken.sum() - want[s]) <= max(g["size"].max(), 1)
        assert (g.taken <= 2 * g["size"]).all()
    again = mixing.mix_table(docs(spark, rows[::-1])).toPandas()
    assert sorted(map(tuple, got[["doc_id", "taken"]].values)) == sorted(map(tuple, again[["doc_id", "taken"]].values))


def test_mix_hot_source_and_documents(spark):
    rows = [(k, "a b c", "hot" if k < 800 else f"s{k % 3}") for k in range(1000)]
    d = docs(spark, rows)
    table = {r.doc_id: r.times for r in mixing.mix_table(d).collect()}
    out = mixing.mix_documents(d)
    assert out.columns == d.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in table.items() if v}


def test_mix_edges(spark):
    assert mixing.mix_table(docs(spark, [])).count() == 0
    assert mixing.mix_documents(docs(spark, [])).count() == 0
    got = mixing.mix_table(docs(spark, [(None, None, None), (None, "", None), (1, " \t", "x")])).collect()
    assert [r.taken for r in got] == [0, 0, 0]
    same = mixing.mix_table(docs(spark, [(1, "a b", "x")] * 4)).collect()
    assert len(same) == 4 and sum(r.taken for r in same) == same[0].target == 12


def test_mix_ties_come_near_the_target(spark):
    for rows in ([(7, "a b c d e", "x")] * 100, [(None, "a b c d e", None)] * 100):
        got = mixing.mix_table(docs(spark, rows)).toPandas()
        assert set(got.target) == {750.0} and got.taken.sum() == 750 and got.taken.max() <= 10


def test_cuts_against_sorting(spark, monkeypatch):
    import random

    r = random.Random(6)
    monkeypatch.setattr("ripplework.llm.cuts.BINS", 7)
    rows, goals = [], {}
    for key in range(12):
        n = r.choice([1, 5, 300])
        mine = [([r.randrange(r.choice([1, 3, 1000])), r.randrange(-50, 50), k], r.randint(0, 9)) for k in range(n)]
        goals[str(key)] = r.uniform(0, 1.1) * sum(w for _, w in mine)
        rows += [(str(key), w, weight) for w, weight in mine]
    df = spark.createDataFrame(rows, "key string, w array<long>, weight long")
    g = spark.createDataFrame([(k, x, None) for k, x in goals.items()], "key string, goal double, slack double")
    for few in (0, 10, 5_000):
        monkeypatch.setattr("ripplework.llm.cuts.FEW", few)
        got = {x.key: x.cut for x in cuts_of(df, g)}
        for key, goal in goals.items():
            upto, want = 0, []
            for _, w, weight in sorted(x for x in rows if x[0] == key):
                upto += weight
                if upto - weight / 2 <= goal:
                    want.append(w)
            assert sorted(x[1] for x in rows if x[0] == key and x[1] <= got[key]) == want, (key, few)


def cuts_of(df, goals):
    from ripplework.llm.cuts import cuts

    return cuts(df, goals, 3).collect()


def test_water_fill_of_many_sources(spark, monkeypatch):
    rows = [(k, "w " * (1 + k % 5), f"s{k % 40:02d}") for k in range(200)]
    want = sorted(map(tuple, mixing.mix_table(docs(spark, rows)).collect()))
    monkeypatch.setattr("ripplework.llm.mixing.BROADCAST_KEYS", 3)
    monkeypatch.setattr("ripplework.llm.cuts.BROADCAST_KEYS", 3)
    assert sorted(map(tuple, mixing.mix_table(docs(spark, rows)).collect())) == want


CLASH = "doc_id long, text string, source string, __times long, __src string, __target double, __row int, __doc string, w int, key string"


def test_mix_leaves_clashing_columns(spark):
    rows = [(k, "a b", "s", 5, "x", 1.5, -k, "d", 9, "k") for k in range(20)]
    out = mixing.mix_documents(spark.createDataFrame(rows, CLASH))
    assert out.columns == [c.split()[0] for c in CLASH.split(", ")] and set(map(tuple, out.collect())) <= set(rows)


def shard_rows(spark, rows, n=16):
    return sharding.shard_table(docs(spark, rows), n).toPandas()


def test_shards_near_equal_and_gapless(spark):
    rows = [(k, "x" * (k * 37 % 900), f"s{k % 3}") for k in range(3000)] + [(5000 + k, "same text", "hot") for k in range(1500)]
    got = shard_rows(spark, rows)
    g = got.groupby("shard").agg(b=("size", "sum"), n=("slot", "size"), lo=("slot", "min"), hi=("slot", "max"), u=("slot", "nunique"))
    assert len(g) == 16 and (g.b - g.b.mean()).abs().max() <= got["size"].max() + 2 * sharding.GROUP_SLACK * g.b.mean()
    assert (g.lo == 0).all() and (g.hi == g.n - 1).all() and (g.u == g.n).all()
    assert set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    text = {i: t for i, t, _ in rows}
    assert all(r["size"] == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for _, r in got.head(50).iterrows())
    small = got[got.text_crc32 != zlib.crc32(b"same text")]
    assert (small.groupby("text_crc32").shard.nunique() > 1).sum() <= 15


def test_shards_of_other_counts_and_edges(spark):
    rows = [(k, "y" * (k % 50), None) for k in range(600)]
    for n in (1, 5, 7):
        b = shard_rows(spark, rows, n).groupby("shard")["size"].sum()
        assert len(b) == n and b.max() - b.min() <= 200
    assert len(shard_rows(spark, [])) == 0
    few = shard_rows(spark, [(None, None, None), (1, "é", "a"), (1, "é", "a")])
    assert sorted(few["size"]) == [1, 3, 3] and few.groupby("shard").slot.max().max() <= 2


def test_shards_of_equal_rows(spark):
    got = shard_rows(spark, [(None, "same", None)] * 1600)
    assert sorted(got.groupby("shard").size()) == [100] * 16 and got.slot.max() == 99


def test_first_cut_is_the_median_of_the_widest_dimension(spark):
    rows = [(k, "x" * (k * 31 % 700) + "\n" * (k % 5), None) for k in range(500)]
    got = shard_rows(spark, rows, 2)
    sizes = got.sort_values("size")["size"].tolist()
    left = got[got.shard == 0]["size"]
    # all bytes of the left shard are on the low side of one size, at half of all bytes
    assert left.max() <= got[got.shard == 1]["size"].min() and abs(left.sum() - sum(sizes) / 2) <= max(sizes) + sharding.GROUP_SLACK * sum(sizes)
