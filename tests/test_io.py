"""Readers and writers, with the odd inputs that files bring."""

import struct

import numpy as np
import pytest

from ripplework.operators import aux_graph as A
from ripplework.sources import edges as src
from ripplework.sources import sinks

LINES = ["# head", "", "   # indented", "1 2", "\t2\t3 extra", "7", "a b", "1 2", "4 4", "-1 5", "9 x"]


def test_edge_list(spark, tmp_path):
    p = tmp_path / "e.txt"
    p.write_text("\n".join(LINES))
    got = sorted(map(tuple, src.read_edges(spark, str(p)).collect()))
    assert got == [(-1, 5), (1, 2), (2, 3), (4, 4)]
    assert src.read_edges(spark, str(p), dedup=False).count() == 5
    assert src.read_edges(spark, str(p), directed=False).count() == 7
    assert src.skipped_lines(spark.read.text(str(p))) == 6


def test_skip_header(spark, tmp_path):
    (tmp_path / "a.txt").write_text("10 20\n1 2\n")
    (tmp_path / "b.txt").write_text("30 40\n3 4\n")
    assert sorted(map(tuple, src.read_edges(spark, str(tmp_path), skip_header=True).collect())) == [(1, 2), (3, 4)]


def test_remap_first_appearance(spark):
    from pyspark.sql import functions as F

    e = spark.createDataFrame([(0, 50, 7), (1, 7, 9), (2, 3, 50)], "pos long, src long, dst long")
    out, ids = src.remap_ids(e, F.col("pos"))
    assert {r.id: r.dense for r in ids.collect()} == {50: 0, 7: 1, 9: 2, 3: 3}
    assert sorted(map(tuple, out.collect())) == [(0, 1), (1, 2), (3, 0)]


def test_compact_check(spark):
    e = spark.createDataFrame([(0, 5)], "src long, dst long")
    assert src.check_compact(e, 6).count() == 1
    with pytest.raises(Exception, match="out of range"):
        src.check_compact(e, 5).collect()


def test_binary(spark, tmp_path):
    a = np.array([(1, 2, 0.5), (3, 4, 0.25)], src.RECORD)
    (tmp_path / "r.bin").write_bytes(a.tobytes())
    assert sorted(map(tuple, src.read_binary_edges(spark, str(tmp_path / "r.bin")).collect())) == [(1, 2, 0.5), (3, 4, 0.25)]
    rev = struct.pack("<Q", 2) + struct.pack("<Q", 0) + struct.pack("<Q", 2) + struct.pack("<If", 0, 0.5) + struct.pack("<If", 7, 0.125)
    (tmp_path / "v.bin").write_bytes(rev)
    assert sorted(map(tuple, src.read_reverse_adjacency(spark, str(tmp_path / "v.bin")).collect())) == [(0, 1, 0.5), (7, 1, 0.125)]


@pytest.fixture(scope="module")
def small(spark):
    return A.build(spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4)], "src long, dst long"), "TRIGGER", 2)


def test_graph_round_trips(spark, tmp_path, small):
    want = sorted(map(tuple, small.edges.collect()))
    sinks.save_graph(small, str(tmp_path / "g"))
    back = sinks.load_graph(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, back.edges.collect())) == want and (back.model, back.factors) == ("TRIGGER", 2)
    sinks.write_graph_text(small, str(tmp_path / "t"), header=True)
    text = sorted(map(tuple, src.read_weighted(spark, str(tmp_path / "t" / "edges"), expected=14).collect()))
    assert [x[:2] for x in text] == [x[:2] for x in want] and all(abs(x[2] - y[2]) < 1e-11 for x, y in zip(text, want))
    with pytest.raises(ValueError):
        src.read_weighted(spark, str(tmp_path / "t" / "edges"), expected=13)
    sinks.write_graph_binary(small, str(tmp_path / "b"))
    raw = b"".join(r[0] for r in spark.read.parquet(str(tmp_path / "b")).collect())
    assert sorted((r["src"], r["dst"]) for r in np.frombuffer(raw, src.RECORD)) == [x[:2] for x in want]
    packed = sorted(map(tuple, src.read_packed_edges(spark, str(tmp_path / "b")).collect()))
    assert [x[:2] for x in packed] == [x[:2] for x in want] and all(abs(x[2] - y[2]) < 1e-6 for x, y in zip(packed, want))


def test_attributes(spark, tmp_path):
    sinks.write_attributes(spark, str(tmp_path / "a"), n=5, m=7)
    assert src.read_attributes(spark, str(tmp_path / "a")) == {"n": "5", "m": "7", "origin_n": "5"}


def test_result_files(spark, tmp_path):
    from ripplework.operators.select import Cover, prefixes

    long = spark.createDataFrame([(0, "A", 0.0), (0, "B", 0.0), (5, "A", 2.0), (5, "B", 3.0)], "size int, algorithm string, influence double")
    sinks.write_results_csv(long, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True, inferSchema=True).columns == ["size", "A", "B"]
    sinks.append_results(long.where("size = 0"), str(tmp_path / "c"))
    sinks.append_results(long.where("size = 5"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 4
    rows = prefixes(Cover([(4, 3), (1, 2)]).table(spark), [1, 2], 10, 20)
    sinks.write_prefixes(rows, str(tmp_path / "p"), "x")
    csv = spark.read.csv(str(tmp_path / "p" / "x_prefix"), header=True)
    assert [r.seeds for r in csv.collect()] == ["4", "4 1"] and len(csv.columns) == 10
    assert spark.read.text(str(tmp_path / "p" / "seed")).where("k = 2").count() == 2
    sinks.write_summary(spark, str(tmp_path / "s"), {"influence": 3.5}, [4, 1])
    assert spark.read.json(str(tmp_path / "s")).first().seeds == "4 1"
    assert sinks.output_name("g", "opim", "IC", 5, eps=0.1) == "g_opim_IC_k5_eps0.1"
