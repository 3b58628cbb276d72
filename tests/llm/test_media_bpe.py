"""Matroska parsing and BPE, each against an independent account of the same bytes."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from ripplework.llm import bpe, media

DOCS = "doc_id long, text string, ids string, media string"
TEXTS = [None, "", "a", "é漢😀" * 40, "x" * 70_000, "\x00", "b" * 64]


@pytest.mark.parametrize("kind", ["none", "xiph", "fixed", "ebml"])
def test_lacing(kind):
    r = random.Random(kind)
    for _ in range(50):
        n = 1 if kind == "none" else r.randint(1, 30)
        size = r.randint(0, 700)
        frames = [bytes([k % 256]) * (size if kind == "fixed" else r.randint(0, 700)) for k in range(n)]
        body = media.uint(media.CLUSTER_TIMESTAMP, 500) + media.simple_block(-20, frames, kind)
        movie = media.read(media._HEAD + media.element(media.SEGMENT, media._TRACK + media.element(media.CLUSTER, body)))
        data = media._HEAD + media.element(media.SEGMENT, media._TRACK + media.element(media.CLUSTER, body))
        assert movie.error is None
        assert [data[p[2] : p[2] + p[3]] for p in movie.packets] == frames
        assert [p[1] for p in movie.packets] == [480_000_000 + k * 16_000_000 for k in range(n)]
        assert {p[5] for p in movie.packets} == {kind}


def test_unknown_sizes_and_block_groups():
    group = media.element(media.BLOCK_GROUP, media.element(media.BLOCK, b"\x81\x00\x05\x00abc") + media.element(media.REFERENCE_BLOCK, b"\x01"))
    unknown = b"\x01" + b"\xff" * 7
    cluster = media.CLUSTER.to_bytes(4, "big") + unknown + media.uint(media.CLUSTER_TIMESTAMP, 7) + group + media.element(0xEC, b"void")
    data = media._HEAD + media.SEGMENT.to_bytes(4, "big") + unknown + media._TRACK + cluster + cluster
    movie = media.read(data)
    assert movie.error is None and movie.clusters == 2
    assert [(p[1], p[3], p[4]) for p in movie.packets] == [(12_000_000, 3, False)] * 2


def test_vint_widths():
    for n in (0, 1, 126, 127, 16382, 16383, 1 << 20, (1 << 49) + 5):
        raw = media.size_vint(n)
        assert media.vint(raw, 0, False)[:2] == (n, len(raw))
    with pytest.raises(media.Malformed):
        media.vint(b"\x00", 0, False)


def test_cues_point_at_clusters():
    payload = media.pad(bytes(range(256)) * 5000)
    data = media.write(payload)
    movie = media.read(data)
    assert media.samples(data, movie) == payload and len(movie.cues) == movie.clusters == 3
    assert all(data[place : place + 4] == media.CLUSTER.to_bytes(4, "big") for _, _, place in movie.cues)
    starts = {}
    for p in movie.packets:
        starts.setdefault(p[6], p[1])
    assert sorted(starts.values()) == [t for t, _, _ in movie.cues]


def test_chained_segments_of_unknown_size():
    unknown = b"\x01" + b"\xff" * 7
    block = lambda n: media.simple_block(0, [bytes([n]) * 5], "none")
    part = lambda n: media._HEAD + media.SEGMENT.to_bytes(4, "big") + unknown + media._TRACK + media.CLUSTER.to_bytes(4, "big") + unknown + media.uint(media.CLUSTER_TIMESTAMP, n) + block(n)
    data = part(3) + part(9) + media._HEAD + media.element(media.SEGMENT, media._TRACK + media.element(media.CLUSTER, media.uint(media.CLUSTER_TIMESTAMP, 4) + block(4)))
    movie = media.read(data)
    assert movie.error is None and movie.clusters == 3
    assert [(p[1], data[p[2] : p[2] + p[3]]) for p in movie.packets] == [(n * 10**6, bytes([n]) * 5) for n in (3, 9, 4)]
    assert all(data[p[6] : p[6] + 4] == media.CLUSTER.to_bytes(4, "big") for p in movie.packets)


def test_cues_join_packets(spark):
    docs = spark.createDataFrame([(1, "ab" * 600_000, "x", "y"), (2, "c", "x", "y")], DOCS)
    stored = media.store_texts(docs)
    packets, cues = media.packet_table(stored, "doc_id", "media"), media.cue_table(stored, "doc_id", "media")
    first = packets.groupBy("media_id", "cluster").agg({"timestamp_ns": "min"}).withColumnRenamed("min(timestamp_ns)", "time_ns")
    assert cues.count() == first.count() == 4 and cues.join(first, ["media_id", "cluster", "time_ns"]).count() == 4


def test_damage_is_reported():
    data = media.write(media.pad(b"q" * 20_000))
    for cut in range(0, len(data), 997):
        movie = media.read(data[:cut])
        assert movie.error
    assert media.read(None).error == "null" and media.read(b"").error


def test_tables(spark):
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(TEXTS)], DOCS)
    stored = media.store_texts(docs)
    packets = media.packet_table(stored, "doc_id", "media")
    sums = {r.media_id: r[1] for r in packets.groupBy("media_id").sum("size").collect()}
    assert sums == {k: len(media.pad((t or "").encode())) for k, t in enumerate(TEXTS)}
    assert media.cue_table(stored, "doc_id", "media").count() == len(TEXTS)
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "doc_id long, media binary")
    assert {r.media_id: r.error is not None for r in media.packet_table(bad, "doc_id", "media").collect()} == {1: True, 2: True}


def test_media_digest(spark):
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate([*TEXTS, "a"])], DOCS)
    rows = {r.doc_id: r for r in media.media_digest(docs).collect()}
    files = {r.doc_id: bytes(r.media) for r in media.store_texts(docs).collect()}
    for k, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_bytes > len(payload)
        blocks = max(1, -(-len(payload) // 1024))
        sums = [sum(payload), sum(x * x for x in payload), max(payload), sum(x < y for x, y in zip(payload, payload[1:]))]
        assert r.feature == f"packets={blocks};clusters={-(-blocks // 512)};cues={-(-blocks // 512)};last_ms={16 * (blocks - 1)};sum={sums[0]};squares={sums[1]};peak={sums[2]};rises={sums[3]}"
        assert (r.media_bytes, r.media_sha256) == (len(files[k]), hashlib.sha256(files[k]).hexdigest())
    assert tuple(rows[2])[1:] == tuple(rows[len(TEXTS)])[1:]
    assert media.media_digest(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.default_path())


PIECES = ["a", "b", " ", "  ", "\n", "\t", "é", "'s", "'re", "'", "1", "²", "##", "　", "\xa0", "\x1c", "\x85", "<|endoftext|>", "漢", "😀", "​", "x" * 60, " the", "The", "̀", "ǅ", "\x7f", "\xad", "_"]


@pytest.mark.parametrize("mean", [4, 16, 512])
def test_bpe_is_exact(codec, monkeypatch, mean):
    monkeypatch.setattr(bpe, "MEAN", mean)
    monkeypatch.setattr(bpe, "LONGEST", max(24, mean * 4))
    r = random.Random(mean)
    letters = PIECES + [chr(k) for k in range(0x250)]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 240))) for _ in range(700)]
    for t, ids in zip(texts, codec.encode_batch(texts)):
        want = codec.tok.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want, repr(t)
        assert codec.decode(ids) == codec.tok.decode(want, skip_special_tokens=False) == t


@pytest.mark.parametrize("places", [lambda cp: np.arange(1, len(cp)), lambda cp: np.arange(3, len(cp), 5), lambda cp: np.arange(0)])
def test_bpe_is_exact_at_any_places(codec, monkeypatch, places):
    """What is accepted depends on the comparison of tokens, not on the choice of places."""
    monkeypatch.setattr(bpe, "MEAN", 12)
    monkeypatch.setattr(bpe, "LONGEST", 40)
    monkeypatch.setattr(bpe, "agreeing", places)
    r = random.Random(3)
    for _ in range(150):
        t = "".join(r.choice(PIECES + ["hello", "ing", "tion"]) for _ in range(r.randint(0, 120)))
        assert codec.encode_batch([t])[0].tolist() == codec.tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_whole_table_is_exact(spark, codec):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r for r in bpe.token_digest(d).collect()}
    for x in d.collect():
        ids = np.array(codec.tok.encode(x.text or "", add_special_tokens=False).ids, "<u4")
        assert (rows[x.doc_id].n_tokens, rows[x.doc_id].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())


def test_copies_come_from_the_store(codec):
    t = " ".join(f"word{k} of a passage" for k in range(400))
    codec.encode_batch([t])
    asked, found = codec.asked, codec.found
    codec.encode_batch([t])
    assert codec.asked - asked == codec.found - found == len(t)


def test_chunks_are_shared():
    r = random.Random(5)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(900)]
    passage = " ".join(r.choices(words, k=1500))
    a, b = ("intro " * 3 + passage), (" ".join(words[:50]) + passage)
    chunks = lambda t: {t[x:y] for x, y in zip([0, *bpe.cuts(bpe.code_points(t))[:-1]], bpe.cuts(bpe.code_points(t)))}
    assert len(chunks(a) & chunks(b)) >= len(chunks(passage)) - 3 > 5


def test_store_is_bounded(codec, monkeypatch):
    monkeypatch.setattr(bpe, "STORE_CHARS", 2000)
    for k in range(30):
        codec.encode_batch([f"text {k} " * 40])
    assert codec.held <= 2000 + 4000


def test_bpe_tables(spark, codec):
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate([*TEXTS, "a <|endoftext|> b", "a"])], DOCS)
    rows = {r.doc_id: r for r in bpe.token_digest(docs).collect()}
    for k, t in enumerate([*TEXTS, "a <|endoftext|> b"]):
        ids = codec.tok.encode(t or "", add_special_tokens=False).ids
        assert rows[k].n_tokens == len(ids)
        assert rows[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {k: t or "" for k, t in enumerate([*TEXTS, "a <|endoftext|> b", "a"])}
    assert bpe.token_digest(docs.limit(0)).count() == 0
