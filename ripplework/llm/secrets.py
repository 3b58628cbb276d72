"""Secret scans: fixed patterns and character Markov models.

Two first-order models over characters, one of random strings and one of ordinary
identifiers and words, are compared by log-likelihood ratio: a run of identifier characters
is a secret if it is likelier random by more than the prior odds.  Runs of ``LEAST_RUN``
characters or more are judged; a shorter one could not outweigh those odds.

Training samples are labelled: random ones are the values that the fixed patterns find in
the corpus and ``SYNTHETIC`` seeded strings over the usual alphabets; ordinary ones are all
other identifier runs of the corpus.  Counts cover all documents; tasks send pair counts
only (at most 66 * 66 cells for each model), so what the driver gets has a fixed bound.

Defined cases: null and empty texts have no spans; spans are in code points with exclusive
ends and found in whole texts; repeated rows repeat results; with an empty table the models
rest on the seeded strings and smoothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, free_memory, map_rows, small_batches

# The patterns that the scan must find, and the least lengths.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_VALUE, ACCESS_LENGTH = 12, 18
KINDS = ("assign", "access", "hex", "markov")
_ASSIGN_HINT = re.compile(r"[:=]")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
LEAST_RUN = 12
RUN = re.compile(r"[A-Za-z0-9+/_-]{12,}")
SIZE = len(ALPHABET) + 1
SYNTHETIC, SEED = 20_000, 42
#: Counts taken off each ordinary pair: a fixed one and a share of all pairs.
NOISE, NOISE_SHARE = 3.0, 2e-6
#: Weight of characters alone against pairs of characters.
BACK_OFF = 5.0
#: A run is taken if its log-likelihood ratio is above this: prior odds of one in a million.
LEAST_RATIO = math.log(1e6)

#: Code of each byte: the place in the alphabet, or the last one for all others.
_CODE = np.full(256, SIZE - 1, np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(SIZE - 1)


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) of the fixed patterns, in order."""
    out = []
    if _ASSIGN_HINT.search(text):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_VALUE:
                out.append((m.start(), 0, m.end(), m.start(2), m.end(2)))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    out += [(m.start(), 2, m.end(), *m.span()) for m in HEX.finditer(text)]
    out.sort()
    return out


def codes(text: str) -> np.ndarray:
    return _CODE[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]


def pair_counts(text: str, weights: np.ndarray) -> None:
    """Add the text's pairs inside identifier runs to ``weights[kind]``: 0 ordinary, 1 random.

    A pair whose first member is no identifier character starts a run.
    """
    c = codes(text)
    if len(c) < 2:
        return
    other = SIZE - 1
    pair = c[:-1] * SIZE + c[1:]
    inside = c[1:] != other
    random_ = np.zeros(len(c), bool)
    for _, _, _, a, b in base_spans(text):
        random_[a:b] = True
    random_ = random_[1:]
    weights[0] += np.bincount(pair[inside & ~random_], minlength=SIZE * SIZE)
    if random_.any():
        weights[1] += np.bincount(pair[inside & random_], minlength=SIZE * SIZE)


def synthetic() -> list[str]:
    r = random.Random(SEED)
    sets = (ALPHABET, ALPHABET[:62], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], "0123456789abcdef", "0123456789ABCDEF")
    return ["".join(r.choices(sets[k % len(sets)], k=r.randint(20, 64))) for k in range(SYNTHETIC)]


def count_pairs(docs: DataFrame) -> DataFrame:
    """cell, ordinary, random: summed over all documents."""

    def run(batches):
        weights = np.zeros((2, SIZE * SIZE), np.int64)
        for batch in batches:
            for text in batch.column(0):
                if t := text.as_py():
                    pair_counts(t, weights)
        cell = np.flatnonzero(weights.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(weights[0, cell]), pa.array(weights[1, cell])], names=["cell", "ordinary", "random"])

    small_batches(docs.sparkSession)
    rows = columns(docs, "text").mapInArrow(run, "cell long, ordinary long, random long")
    return rows.groupBy("cell").agg(F.sum("ordinary").alias("ordinary"), F.sum("random").alias("random"))


def train(docs: DataFrame) -> np.ndarray:
    """The log-likelihood ratio of each pair of characters, random against ordinary."""
    weights = np.zeros((2, SIZE * SIZE), np.int64)
    for row in count_pairs(docs).collect():  # at most SIZE * SIZE rows
        weights[:, row["cell"]] = row["ordinary"], row["random"]
    for s in synthetic():
        c = codes(" " + s)
        weights[1] += np.bincount(c[:-1] * SIZE + c[1:], minlength=SIZE * SIZE)
    n = weights.reshape(2, SIZE, SIZE).astype(np.float64)
    # unknown secrets sit among the ordinary runs: pairs that are rare there are not believed
    n[0] = np.maximum(0.0, n[0] - NOISE - NOISE_SHARE * n[0].sum())
    # characters after others, backed off to characters alone, so that a letter which
    # ordinary text never shows is unlikely after any other
    alone = n.sum(1, keepdims=True) + 0.5
    alone /= alone.sum(2, keepdims=True)
    p = np.log((n + BACK_OFF * alone) / (n.sum(2, keepdims=True) + BACK_OFF))
    return p[1] - p[0]


def ratio(run: str, table: np.ndarray) -> float:
    c = codes(run)
    return float(table[c[:-1], c[1:]].sum())


def spans(text: str | None, table: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end): the base spans, and runs outside any one of them that the models call random."""
    if not text:
        return []
    base = [(a, k, b) for a, k, b, _, _ in base_spans(text)]
    found = []
    at, reach = 0, 0  # base spans that start up to here, and the furthest end of these
    for m in RUN.finditer(text):
        a, b = m.span()
        while at < len(base) and base[at][0] <= a:
            reach, at = max(reach, base[at][2]), at + 1
        if b > reach and ratio(m.group(), table) > LEAST_RATIO:
            found.append((a, 3, b))
    return sorted(base + found)


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def secret_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every document."""
    table = train(docs)

    def make():
        def step(x: dict) -> dict:
            every = [spans(t, table) for t in x["text"]]
            base = [[s for s in found if s[1] < 3] for found in every]
            count = lambda k: [sum(s[1] == k for s in found) for found in base]
            return {
                "doc_id": x["doc_id"],
                "n_assign": count(0),
                "n_access": count(1),
                "n_hex": count(2),
                "base_sha256": [hashlib.sha256(_joined(b).encode()).hexdigest() for b in base],
                "spans": [_joined(found) for found in every],
            }

        return step

    return map_rows(columns(docs, "doc_id", "text"), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


MASK = "[SECRET]"


def masked(text: str | None, table: np.ndarray) -> str | None:
    """The text with every span (those that overlap count as one) replaced by the mask."""
    found = spans(text, table)
    if not found:
        return text
    out, at, done = [], 0, 0
    for a, _, b in found:
        if a >= done:
            out += [text[at:a], MASK]
        done = max(done, b)
        at = done
    return "".join([*out, text[at:]])


def mask_documents(docs: DataFrame) -> DataFrame:
    """All documents, with secrets masked in their texts and n_chars counted anew."""
    table = train(docs)

    def run(texts: pa.Array) -> pa.Array:
        out = pa.array((masked(t.as_py(), table) for t in texts), pa.string())
        free_memory()
        return out

    mask: Column = F.arrow_udf(run, "string").asNondeterministic()(F.col("text"))
    out = docs.withColumn("text", mask)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out
