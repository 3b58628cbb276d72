"""SimHash near-duplicates by anchor-point covering.

Fingerprints: words, word shingles, the 64-bit XXH64 (seed 42) of each shingle; a bit is
set if it is set in more than half of the shingles' hashes.

Links at ``distance`` 3 or fewer: of two linked fingerprints, at least one 32-bit half
differs in at most one bit.  (Up to 5 would do: both halves' owners reach the anchor next to
the point midway between two halves that differ in two bits.)  The anchors of a half are a
covering code with radius 1: the perfect Hamming code of length 31 beside one free bit, 2^27
anchors.  A half is replicated
to every anchor within covering radius plus that one bit, so two halves that differ in at
most one bit meet at the nearest anchor of either.  That is 16.5 anchors on average,
computed by table from the syndrome (five parities), natively.  At each anchor the 64-bit
fingerprints are compared; only a spanning forest of the links goes out, never all pairs.

Exact copies of a fingerprint are one row throughout.  An anchor with more than
``CHUNK`` fingerprints is compared in blocks: its rows are passed on in parts of that size,
dealt anew, and each pair of parts is a cell of its own, so no anchor is held in one task, and
nothing is capped.
Within a block, a search from one fingerprint takes all unvisited ones in reach out of the
rest, so a dense group of near copies costs about one comparison for each member.

Components: alternating large-star and small-star rounds over (fingerprint, fingerprint)
edges, each written to the shared folder, until nothing changes.  Hubs, that is, nodes or
fingerprints with a large share of all rows, are joined by broadcast (``join_split``).

Defined cases: null and empty texts, and those without words, have fingerprint zero and
link like others; a text with fewer words than a shingle is one shingle; repeated rows are
copies; null doc_ids keep their component but are never its name; a component with no
doc_id at all has a null name; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, columns, free_memory, free_name, join_split, map_rows, materialize, release

SEED = 42
DISTANCE = 3
CHUNK = 20_000
_WORD = re.compile(WORD)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 16


def shingles(text: str | None, size: int) -> list[str]:
    words = _WORD.findall((text or "").translate(_LOWER))
    if len(words) <= size:
        return [" ".join(words)] if words else []
    return [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def fingerprint(text: str | None, size: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer."""
    parts = shingles(text, size)
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(p, SEED) for p in parts], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = hashes[at : at + _BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp for every document."""

    def make():
        return lambda x: {"doc_id": x["doc_id"], "fp": [fingerprint(t, size) for t in x["text"]]}

    return map_rows(columns(docs, "doc_id", "text"), make, "doc_id long, fp long")


# ---------------------------------------------------------------- anchors


def _flips() -> list[list[int]]:
    """By syndrome: the masks that lead from a half to each anchor within distance 2.

    Bits 0 to 30 are the Hamming code's places 1 to 31 and bit 31 is the free one.
    """
    out = []
    for s in range(32):
        home = 1 << (s - 1) if s else 0
        masks = [home, home | 1 << 31]
        masks += [1 << (j - 1) | 1 << (k - 1) for j in range(1, 32) if (k := j ^ s) > j] if s else []
        out.append([m - (1 << 32) if m >> 31 else m for m in masks])
    return out


#: Bits of the places whose number has bit b set: the code's parity checks.
_PARITY = [sum(1 << (p - 1) for p in range(1, 32) if p >> b & 1) for b in range(5)]


def syndrome(half: Column) -> Column:
    out = None
    for b, mask in enumerate(_PARITY):
        bit = F.shiftleft(F.bit_count(half.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)), b)
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def _moved(masks: Column, half: Column, k: int) -> Column:
    return F.transform(masks, lambda m: half.bitwiseXOR(m.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))) + F.lit(k << 32))


def anchored(fps: DataFrame, *others: str) -> DataFrame:
    """anchor, fp: each fingerprint at all of its anchors; bit 32 of the anchor is the half."""
    flips = F.array(*(F.array(*(F.lit(m) for m in masks)) for masks in _flips()))
    low = F.col("fp").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    out = None
    for k, half in enumerate((low, high)):
        masks = F.element_at(flips, syndrome(half) + 1)
        spread = _moved(masks, half, k)
        out = spread if out is None else F.concat(out, spread)
    return fps.select(F.explode(out).alias("anchor"), "fp", *others)


# ---------------------------------------------------------------- comparing


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; unsigned, since numpy counts the bits of a signed number's magnitude."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest(fp: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root), as places in ``fp``, that connect exactly what its links connect."""
    rest = np.arange(len(fp))
    members, roots = [], []
    while len(rest) > 1:
        root, front, rest = rest[0], [rest[0]], rest[1:]
        while front and len(rest):
            near = apart(fp[rest], fp[front.pop()]) <= distance
            if near.any():
                found = rest[near]
                members.append(found)
                roots.append(np.full(len(found), root))
                front.extend(found.tolist())
                rest = rest[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *members]), np.concatenate([none, *roots])


def _compare_runs(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges, as places, inside runs of equal ``key``; a run's fingerprints are distinct."""
    none = np.zeros(0, np.int64)
    if not len(key):
        return none, none
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    left, right = [], []
    # runs of a few: compare all rows with those some places behind, for all runs at once
    few = 12
    small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= few), sizes))
    k, f = key[small], fp[small]
    for lag in range(1, few):
        if len(k) <= lag:
            break
        hit = np.flatnonzero((k[lag:] == k[:-lag]) & (apart(f[lag:], f[:-lag]) <= distance))
        left.append(small[hit + lag])
        right.append(small[hit])
    for at, n in zip(starts[sizes > few], sizes[sizes > few]):
        a, b = forest(fp[at : at + n], distance)
        left.append(a + at)
        right.append(b + at)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("fp", pa.int64()), ("node", pa.int64())])


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], most: int) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Rows sorted by ``names[0]``, in pieces that no run of equal keys is cut by; but a run of
    more than ``most`` rows comes in parts as it arrives, each marked, so that no more than
    about ``most`` rows and a batch are ever held."""
    held: list[list[np.ndarray]] = []
    size, hot = 0, None  # hot: the key of a run that is being passed on
    for batch in batches:
        cols = [_column(batch, n) for n in names]
        while len(cols[0]):
            k = cols[0]
            if hot is not None:
                n = int(np.searchsorted(k, hot, "right")) if k[0] == hot else 0
                if n:
                    yield [c[:n] for c in cols], True
                    cols = [c[n:] for c in cols]
                    continue
                hot = None
            cut = int(np.searchsorted(k, k[-1], "left"))
            if held and held[0][0][0] != k[-1] and not cut:
                yield [np.concatenate(c) for c in zip(*held)], False
                held, size = [], 0
            if cut:
                yield [np.concatenate(c) for c in zip(*held, [c[:cut] for c in cols])], False
                held, size = [], 0
            held.append([c[cut:] for c in cols])
            size += len(k) - cut
            cols = [c[:0] for c in cols]
            if size > most:
                hot = held[0][0][0]
                yield [np.concatenate(c) for c in zip(*held)], True
                held, size = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held)], False


def links(fps: DataFrame, distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """a, b: edges between different fingerprints that connect what links connect.

    ``fps`` has distinct fingerprints in the column fp.
    """
    return meet(anchored(fps).withColumn("node", F.col("fp")), distance, chunk)


def meet(rows: DataFrame, distance: int, chunk: int = CHUNK) -> DataFrame:
    """a, b: edges between nodes of ``rows(anchor, fp, node)`` that share an anchor, enough to
    connect all pairs that differ in at most ``distance`` bits of ``fp`` there.

    A run of up to ``chunk`` rows is compared as it comes.  The rows of a larger one are passed
    on in parts of that size and dealt into cells of two parts each, so no task compares or
    holds more than two parts, however many rows an anchor has.
    """

    def compare(k: np.ndarray, f: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # equal fingerprints at an anchor are one row, tied to their first node
        order = np.lexsort((node, f, k))
        k, f, node = k[order], f[order], node[order]
        again = np.concatenate(([False], (k[1:] == k[:-1]) & (f[1:] == f[:-1])))
        first = np.maximum.accumulate(np.where(again, 0, np.arange(len(k))))
        kept = np.flatnonzero(~again)
        a, b = _compare_runs(k[kept], f[kept], distance)
        a, b = np.concatenate((np.flatnonzero(again), kept[a])), np.concatenate((first[again], kept[b]))
        # all that is connected goes to its smallest node, so that most anchors of a group of
        # copies give the same edges and no run gives more edges than it has rows
        least = node.copy()
        while True:
            m = np.minimum(least[a], least[b])
            if (least[a] == m).all() and (least[b] == m).all():
                break
            np.minimum.at(least, a, m)
            np.minimum.at(least, b, m)
        tied = node != least
        return node[tied], least[tied]

    def first(batches):
        for (k, f, node), hot in _runs(batches, ("anchor", "fp", "node"), chunk):
            if hot:
                none = pa.nulls(len(k), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(k), pa.array(f), pa.array(node)], schema=_EDGE)
            else:
                a, b = compare(k, f, node)
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none, none], schema=_EDGE)

    rows = rows.select("anchor", "fp", "node").repartition(F.col("anchor")).sortWithinPartitions("anchor")
    rows = materialize(rows.mapInArrow(first, "a long, b long, key long, fp long, node long"), "anchor_edges")
    cold = rows.where("key IS NULL AND a <> b").select("a", "b")
    hot = rows.where("key IS NOT NULL").select("key", "fp", "node")
    counts = hot.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("parts"))
    if counts.isEmpty():
        return cold

    def second(batches):
        for (k, f, node), _ in _runs(batches, ("cell", "fp", "node"), 1 << 62):
            a, b = compare(k, f, node)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    mine = F.pmod(F.xxhash64("node"), F.col("parts"))
    dealt = _dealt(hot.join(F.broadcast(counts) if counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else counts, "key"), mine)
    cells = dealt.select("fp", "node", F.xxhash64("key", "ij").alias("cell"))
    found = cells.repartition(F.col("cell")).sortWithinPartitions("cell").mapInArrow(second, "a long, b long")
    return cold.union(found.where("a <> b"))


def _dealt(rows: DataFrame, mine: Column) -> DataFrame:
    """Each row once for every pair of parts that holds its part ``mine``, as the column ij."""
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: (F.col("parts") == 1) | (o != mine))
    return rows.withColumn("ij", F.explode(F.transform(others, lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j")))))


# ---------------------------------------------------------------- components


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root for every node of an edge; root is the smallest node of its component.

    ``edges`` has columns a and b.  Rounds of large-star and small-star (Kiveris et al.,
    2014): edges are grouped by node, each step sends a node's neighbours to the smallest.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "edges")
    seen, n_edges = None, e.count()
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large-star: every larger neighbour of u goes to the smallest of u and its neighbours
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("__n"))
        large = join_split(both.where("v > u"), least, "u", 2 * n_edges).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("__n"))
        small = join_split(large, low, "u", n_edges).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        new = materialize(small.select("x.u", "x.v").where("u <> v").distinct(), "edges")
        mark = new.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        release(e)
        e, n_edges = new, mark[0]
        if seen == tuple(mark):
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        seen = tuple(mark)
    raise RuntimeError("components did not settle")


def cluster(docs: DataFrame, size: int = 3, distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """doc_id, fp, component_id for every document."""
    prints = materialize(fingerprints(docs, size), "fingerprints")
    named = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("__n")), "distinct_fingerprints")
    nodes = components(links(named.select("fp"), distance, chunk))
    rooted = materialize(named.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "__n", F.coalesce("root", "fp").alias("root")), "rooted")
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("__n"))
    by_fp = join_split(rooted.withColumnRenamed("__n", "rows"), best, "root", rooted.count()).select("fp", "component_id", F.col("rows").alias("__n"))
    return join_split(prints, materialize(by_fp, "components"), "fp", prints.count())


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def cluster_table(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id: 3-word shingles, at most 3 differing bits."""
    return cluster(docs).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- documents

#: Fingerprints of a document's word set, and the distance at which they make a candidate.
PRINTS, REACH = 1, 5
#: Min-hash fingerprints of the shingle set (64 bits each), and the distance of the next one
#: of them at which two documents that meet at an anchor of one become candidates.
MIN_PRINTS, MIN_REACH = 4, 17
WORDS, SIMILARITY = 5, 0.8
#: Documents in a part of a large set of candidates, and hashes for each of them; two parts meet in a task.
GROUP, HASHES = 1_000, 500
#: Rows up to which a set of row numbers is broadcast (8 bytes each).
BROADCAST_ROWS = 2_000_000
#: Bytes of a text that are hashed at once.
_HASHED = 1 << 20
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_FACTORS = np.random.default_rng(SEED).integers(1 << 31, 1 << 32, 64 * MIN_PRINTS, dtype=np.uint32) | np.uint32(1)

#: Products of a block of keys and all factors; small enough for a core's cache.
_TABLE = np.empty((256, len(_FACTORS)), np.uint32)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LETTERS = np.random.default_rng(SEED + 1).integers(0, 1 << 64, 256, dtype=np.uint64)
_LETTERS[ord("A") : ord("Z") + 1] = _LETTERS[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15 | 1


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(_HASHED, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit polynomial hash of each lower-cased word, without a loop over words: prefix sums
    of (value of a byte) * base^place, and a word's difference moved back to place 0."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) <= _HASHED:
        return _hash_block(raw)
    out, at = [], 0
    while at < len(raw):
        end = at + _HASHED
        if end < len(raw):
            space = np.flatnonzero(_SPACE[raw[at:end]])
            if not len(space):  # one word is longer than a block
                rest = np.flatnonzero(_SPACE[raw[end:]])
                end = end + int(rest[0]) if len(rest) else len(raw)
                out.append(np.array([xxhash.xxh64_intdigest(raw[at:end].tobytes().lower(), SEED)], np.uint64))
                at = end
                continue
            end = at + int(space[-1]) + 1
        out.append(_hash_block(raw[at:end]))
        at = end
    return np.concatenate([np.zeros(0, np.uint64), *out])


def _hash_block(raw: np.ndarray) -> np.ndarray:
    solid = np.zeros(len(raw) + 2, np.int8)
    solid[1:-1] = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(solid))
    if not len(edges):
        return np.zeros(0, np.uint64)
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers()
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LETTERS[raw] * power[: len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * _MIX[3]
    return h ^ (h >> np.uint64(29))


def sequence_keys(h: np.ndarray) -> tuple[int, int]:
    """Two 64-bit keys of a sequence of word hashes."""
    raw = h.tobytes()
    return tuple(int(np.uint64(xxhash.xxh64_intdigest(raw, k)).astype(np.int64)) for k in (1, 2))


def word_set_prints(text: str | None, prints: int = PRINTS) -> tuple[int, int, list[int]]:
    """Two keys of the lower-cased word sequence, and fingerprints of the set of its words.

    A changed word changes five 5-word shingles but one word, so near copies whose shingle
    fingerprints differ in ten bits differ in two or three here; links are only candidates.
    """
    h = word_hashes(text)
    return *sequence_keys(h), set_prints(h, prints)


def set_prints(h: np.ndarray, prints: int = PRINTS) -> list[int]:
    if not len(h):
        return [0] * prints
    h = np.unique(h)
    out = []
    with np.errstate(over="ignore"):
        for m in _MIX[:prints]:
            x = (h ^ (h >> np.uint64(31))) * m
            x ^= x >> np.uint64(29)
            bits = np.unpackbits((x * _MIX[0]).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            out.append(int(np.packbits(2 * bits > len(h)).view(">i8")[0]))
    return out


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """The distinct 64-bit keys of all runs of ``size`` words (the whole, if there are fewer)."""
    if not len(h):
        return np.zeros(0, np.int64)
    size = min(size, len(h))
    key = np.full(len(h) - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            key = (key ^ (key >> np.uint64(32))) * _MIX[1] + h[k : len(h) - size + 1 + k]
        key = (key ^ (key >> np.uint64(32))) * _MIX[2]
    return np.unique((key ^ (key >> np.uint64(29))).view(np.int64))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return shingle_hashes(word_hashes(text), size)


def min_prints(shingle_keys: np.ndarray) -> list[int]:
    """Bits that each are the parity of a min-hash: two sets of similarity s differ in a share
    of (1 - s) / 2 of them, however the difference is spread over the texts."""
    if not len(shingle_keys):
        return [0] * MIN_PRINTS
    x = (shingle_keys.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), len(_TABLE)):
        part = x[at : at + len(_TABLE), None]
        np.minimum(least, np.multiply(part, _FACTORS, out=_TABLE[: len(part)]).min(0), out=least)
    # products keep the keys' last bit, so the minima are mixed before a bit is taken
    least ^= least >> np.uint32(15)
    least *= np.uint32(0x2C1B3C6D)
    least ^= least >> np.uint32(12)
    return np.packbits(least & np.uint32(1)).view(">i8").astype(np.int64).tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def similar_forest(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root), as places in ``sets``, that connect exactly what pairs of at
    least this ``jaccard`` connect.

    A set comes to the front only as similar to one that was there, and is then compared
    with all that have not been reached: postings of the hashes count what it shares.
    """
    size = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(size)
    code = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_inverse=True)[1]
    codes = int(code.max()) + 1 if len(code) else 0
    order = np.argsort(code, kind="stable")
    owner, of = np.repeat(np.arange(len(sets)), size)[order], code[order]
    rest = np.ones(len(sets), bool)
    left = indexed = len(sets)
    count = np.bincount(of, minlength=codes)
    first = np.cumsum(count) - count
    members, roots = [], []
    for root in range(len(sets)):
        if not rest[root]:
            continue
        rest[root] = False
        left -= 1
        front = [root]
        while front and left:
            if 2 * left < indexed:  # postings of those that are left
                keep = rest[owner]
                owner, of, indexed = owner[keep], of[keep], left
                count = np.bincount(of, minlength=codes)
                first = np.cumsum(count) - count
            x = front.pop()
            own = code[ends[x] - size[x] : ends[x]]
            n = count[own]
            # a similar set lacks at most this share of the hashes, so it has one of any few more
            few = len(own) - math.ceil(similarity * len(own) - 1e-6) + 1
            if few < len(own):
                rare = np.argpartition(n, few - 1)[:few]
                if not rest[owner[_ranges(first[own[rare]], n[rare])]].any():
                    continue
            both = np.bincount(owner[_ranges(first[own], n)], minlength=len(sets))
            union = size[x] + size - both
            found = np.flatnonzero(rest & (both / np.maximum(union, 1) >= similarity) | rest & (union == 0))
            if len(found):
                rest[found] = False
                left -= len(found)
                members.append(found)
                roots.append(np.full(len(found), root))
                front.extend(found.tolist())
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *members]), np.concatenate([none, *roots])


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), then those of the next."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Rows and sets of hashes of each run of one cell."""
    last, rows, sets = None, [], []
    for b in batches:
        lists = b.column("hashes")
        at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        for k, (cell, row) in enumerate(zip(b.column("cell").to_pylist(), b.column("__row").to_pylist())):
            if cell != last and rows:
                yield np.array(rows, np.int64), sets
                rows, sets = [], []
            last = cell
            rows.append(row)
            sets.append(values[at[k] : at[k + 1]].copy())
    if rows:
        yield np.array(rows, np.int64), sets


def _few(rows: DataFrame) -> DataFrame:
    """Broadcast a slim table if a count shows that it is small; else Spark joins by shuffle."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def candidate_rows(nodes: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """anchor, fp, node: for each (own, check) both halves of the fingerprint ``own`` at their
    anchors, with the fingerprint ``check`` that two nodes which meet there are compared by."""
    out = None
    for k, (own, check) in enumerate(pairs):
        rows = anchored(nodes.select(F.col(own).alias("fp"), "node", F.col(check).alias("check")), "node", "check")
        rows = rows.select((F.col("anchor") + F.lit(k << 33)).alias("anchor"), F.col("check").alias("fp"), "node")
        out = rows if out is None else out.unionByName(rows)
    return out


def near_copies(numbered: DataFrame, size: int = WORDS, similarity: float = SIMILARITY, prints: int = PRINTS, chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """__row, root for rows of ``numbered(__row, text)``; rows of one group have one root.

    Rows with the same words in order are one node.  Candidates are nodes that anchor-point
    covering brings together by a fingerprint of their word sets, which is compared itself, or
    by one of their shingle sets, where the next of these is compared.  At similarity 0.8 a half
    of the latter differs in 3.2 of 32 bits and meets its like (2 bits or fewer) in 37 of 100
    cases, at 0.85 in 57 and at 0.9 in 79; one at least of eight halves does so in 97, 99.8 and
    99.99, wherever the texts differ.  Texts that differ in scattered words meet by the word set
    as well.  What these links connect is a set of candidates.  In a set, all pairs are settled by the exact
    similarity of their ``size``-word shingles, and groups are what the similar pairs connect.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")

    def make():
        def step(x: dict) -> dict:
            every = []
            for t in x["text"]:
                h = word_hashes(t)
                every.append((*sequence_keys(h), *set_prints(h, prints), *min_prints(shingle_hashes(h, size))))
            return {"__row": x["__row"], **{c: [e[k] for e in every] for k, c in enumerate(cols)}}

        return step

    ws, ms = [f"w{i}" for i in range(prints)], [f"m{i}" for i in range(MIN_PRINTS)]
    cols = ["k1", "k2", *ws, *ms]
    keyed = materialize(map_rows(columns(numbered, "__row", "text"), make, "__row long, " + ", ".join(f"{c} long" for c in cols)), "prints")
    nodes = materialize(keyed.groupBy("k1", "k2").agg(F.min("__row").alias("node"), *(F.min(f).alias(f) for f in (*ws, *ms)), F.count(F.lit(1)).alias("__n")), "nodes")
    by_words = candidate_rows(nodes, [(w, w) for w in ws])
    by_shingles = candidate_rows(nodes, [(m, ms[(i + 1) % MIN_PRINTS]) for i, m in enumerate(ms)])
    found = meet(by_words, REACH, chunk).unionByName(meet(by_shingles, MIN_REACH, chunk))
    found = materialize(components(found).select(F.col("node").alias("__row"), F.col("root").alias("set")), "candidates")

    def sets():
        return lambda x: {"__row": x["__row"], "hashes": [shingle_set(t, size) for t in x["text"]]}

    some = columns(numbered, "__row", "text").join(_few(found.select("__row")), "__row", "left_semi")
    held = materialize(map_rows(some, sets, "__row long, hashes array<long>"), "shingle_sets")
    roots = settle(found.join(held.select("__row", F.size("hashes").alias("n")), "__row"), held, similarity, group)
    named = nodes.select("k1", "k2", "__n", "node").join(roots, "node", "left").select("k1", "k2", "__n", F.coalesce("root", "node").alias("root"))
    named = named.select(F.xxhash64("k1", "k2").alias("key"), F.struct("k1", "k2").alias("k"), "__n", "root")
    rows = keyed.select("__row", F.struct("k1", "k2").alias("k"))
    out = materialize(join_split(rows, named.drop("key"), "k", rows.count()).select("__row", "root"), "roots")
    for used in (keyed, nodes, found, held):
        release(used)
    return out


def settle(members: DataFrame, held: DataFrame, similarity: float, group: int = GROUP) -> DataFrame:
    """node, root: what pairs of at least this similarity connect within each candidate set.

    ``members(__row, set, n)`` has the number of hashes of each, ``held(__row, hashes)`` the
    hashes.  A set that is larger than a part is dealt into parts.  First every part is
    settled alone; copies of one text, however many, mostly become one group by that.  Then
    only rows of the sets that are still more than one group meet: those outside their set's
    largest group with each other and with all rows of that group.  No pair of different
    groups is left out, and a row is sent as often as there are parts outside the largest
    group, not as often as there are parts.
    """
    sizes = members.groupBy("set").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))
    parts = F.least("rows", F.ceil(F.greatest(F.col("rows") / group, F.col("n") / (group * HASHES)))).alias("parts")
    sizes = materialize(sizes.where("rows > 1").select("set", parts, "rows", F.col("rows").alias("__n")), "sets")
    total = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    dealt = join_split(members.select("__row", "set"), sizes, "set", total)
    dealt = materialize(dealt.withColumn("part", F.pmod(F.xxhash64("__row"), F.col("parts"))), "dealt")
    edges = _similar(dealt.select("__row", F.xxhash64("set", "part").alias("cell")), held, similarity)
    large = dealt.where("parts > 1")
    if large.isEmpty():
        return components(edges)
    # how far the parts alone have come
    so_far = components(edges).withColumnRenamed("node", "__row")
    state = materialize(large.join(so_far, "__row", "left").select("__row", "set", "rows", "parts", "part", F.coalesce("root", "__row").alias("root")), "state")
    groups = state.groupBy("set", "root").agg(F.count(F.lit(1)).alias("size"))
    main = groups.groupBy("set").agg(F.max(F.struct("size", "root")).alias("x"), F.sum("size").alias("__n"))
    main = main.select("set", F.col("x.root").alias("main"), (F.col("__n") - F.col("x.size")).alias("outside"), "__n").where("outside > 0")
    main = materialize(main, "main")
    open_ = join_split(state, main, "set", state.count())
    open_ = open_.withColumn("out_parts", F.ceil(F.col("outside") * F.col("parts") / F.col("rows")))
    inside = F.col("root") == F.col("main")
    at = F.pmod(F.xxhash64("__row", F.lit(1)), F.col("out_parts"))
    # a cell is a part of the rows outside and either such a part or one of the largest group
    every = F.sequence(F.lit(0).cast("long"), F.col("out_parts") - 1)
    cell = lambda kind, a, b: F.xxhash64("set", F.lit(kind), a, b)
    rows_in = open_.where(inside).select("__row", F.explode(F.transform(every, lambda o: cell("in", o, F.col("part")))).alias("cell"))
    outside = open_.where(~inside).withColumn("o", at)
    rows_out = outside.select("__row", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: cell("in", F.col("o"), p))).alias("cell"))
    among = outside.select("__row", F.explode(F.transform(every, lambda o: cell("out", F.least("o", o), F.greatest("o", o)))).alias("cell"))
    more = _similar(rows_in.unionByName(rows_out).unionByName(among), held, similarity)
    return components(edges.unionByName(more))


def _similar(cells: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """a, b: edges that connect what pairs of at least this similarity connect in each cell."""

    def search(batches):
        for rows, held_sets in _cells(batches):
            a, b = similar_forest(held_sets, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(rows[a]), pa.array(rows[b])], names=["a", "b"])
        free_memory()

    dealt = cells.join(held, "__row").select("cell", "__row", "hashes").repartition(F.col("cell")).sortWithinPartitions("cell")
    return materialize(dealt.mapInArrow(search, "a long, b long"), "near")


def dedup_documents(docs: DataFrame, size: int = WORDS, similarity: float = SIMILARITY, prints: int = PRINTS, chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """One document of each group of near copies stays (that of the smallest doc_id, and of
    rows that repeat it the first stored), with the columns of ``docs``.

    Rows are numbered in a stored copy, so null and repeated doc_ids need no special care; the
    rows that go are found from slim tables and taken out by an anti-join on the number, which
    leaves the texts where they are while those rows are few enough to broadcast.
    """
    own = free_name(docs, "__row")
    numbered = materialize(docs.withColumn(own, F.monotonically_increasing_id()), "numbered")
    slim = numbered.select(F.col(own).alias("__row"), "doc_id", "text")
    found = near_copies(slim, size, similarity, prints, chunk, group)
    order = slim.select("__row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row").alias("__order"))
    rows = materialize(found.join(order, "__row"), "ordered")
    stay = rows.groupBy("root").agg(F.min("__order").alias("first"))
    gone = rows.select("__row").join(stay.select(F.col("first.__row").alias("__row")), "__row", "left_anti")
    gone = materialize(gone.withColumnRenamed("__row", own), "gone")
    for used in (found, rows):
        release(used)
    return numbered.join(_few(gone), own, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
