"""Language identification by bit-sliced Bloom filters of n-grams.

Each language has a Bloom filter of its letter n-grams; the filters lie across each other,
so that one slot is a mask of languages and the AND over an n-gram's slots gives all
languages that (may) contain it.  A document's n-grams are looked up; the bits of each
language are counted; from each count the false positives that the language's fill lets
expect are taken off: (hits - n * rate) / (1 - rate).  N-grams of all languages tell nothing
and fall out of the comparison by adding the same to each.

Learning counts n-grams over all training documents with a known language.  A language
contains an n-gram that makes up at least ``SHARE`` of its n-grams: all of them up to
1 / SHARE n-grams of text, and beyond that not those that a corpus of any language shows now
and then (names, quotations), of which a larger corpus has more.  So the driver gets at most
1 / SHARE rows for each language; the filters' size follows the largest of these counts.

Defined cases: null texts and texts without a letter are ``und`` with score 0; documents
with a null lang are not learned from; every other language with a letter in its texts is learned,
however few; with nothing to learn all are ``und``; ties, and texts of n-grams that no
language has, go to the language that comes first by code point; repeated rows repeat results; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, map_rows, small_batches

N = 4
SHARE = 2e-6
#: Least slots of the filters, slots for each n-gram of the largest language, and slots that an n-gram sets.
SLOTS, SPACE, HASHES = 1 << 16, 12, 3
_LETTER = re.compile(r"[^\W\d_]")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def grams(text: str) -> np.ndarray:
    """A 64-bit key for each n-gram of the lower-cased letters, words set apart by a space,
    and for each word of one letter, which no n-gram holds alone.

    Code points have 21 bits, so three fit exactly and a fourth is mixed in.
    """
    clean = _NOT_LETTER.sub(" ", f" {text} ".lower())
    cp = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    single = cp[1:-1][(cp[:-2] == 32) & (cp[2:] == 32) & (cp[1:-1] != 32)] if len(cp) > 2 else cp[:0]
    key = np.zeros(max(0, len(cp) - N + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(N if len(key) else 0):
            key = key * np.uint64(0x200003) + cp[k : len(cp) - N + 1 + k]
    return np.concatenate((key, ~single))


def slots(keys: np.ndarray, size: int) -> np.ndarray:
    """HASHES rows of slots; ``size`` is a power of two."""
    shift = np.uint64(64 - size.bit_length() + 1)
    with np.errstate(over="ignore"):
        return np.stack([((keys ^ (keys >> np.uint64(29))) * m) >> shift for m in _MIX[:HASHES]])


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n: n-grams of the documents of each language; sums of each task's counts."""

    def run(batches):
        import pyarrow as pa

        def out(held: dict[str, list[np.ndarray]]):
            for lang, parts in held.items():
                k, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

        held: dict[str, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if t := text.as_py():
                    held.setdefault(lang, []).append(grams(t))
                    size += len(held[lang][-1])
                    if size > 8_000_000:
                        yield from out(held)
                        held, size = {}, 0
        yield from out(held)

    small_batches(docs.sparkSession)
    known = columns(docs, "lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    return known.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """The filters of all languages, and what they say of a text."""

    def __init__(self, kept: dict[str, np.ndarray]):
        self.langs = sorted(kept)
        most = SPACE * max((len(k) for k in kept.values()), default=0)
        self.size = max(SLOTS, 1 << (max(1, most) - 1).bit_length())
        self.bits = np.zeros((self.size, max(1, -(-len(self.langs) // 8))), np.uint8)
        for i, lang in enumerate(self.langs):
            self.bits[slots(kept[lang].view(np.uint64), self.size).ravel(), i // 8] |= np.uint8(1 << i % 8)
        fill = [float(((self.bits[:, i // 8] >> (i % 8)) & 1).mean()) for i in range(len(self.langs))]
        self.rate = np.array(fill) ** HASHES

    def containing(self, keys: np.ndarray) -> np.ndarray:
        """For each n-gram the mask of languages that contain it."""
        at = slots(keys, self.size)
        out = self.bits[at[0]]
        for row in at[1:]:
            out = out & self.bits[row]
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not _LETTER.search(text) or not self.langs:
            return "und", 0.0
        keys = grams(text)
        masks = self.containing(keys)
        hits = np.array([int(((masks[:, i // 8] >> (i % 8)) & 1).sum()) for i in range(len(self.langs))], float)
        real = np.maximum(0.0, (hits - len(keys) * self.rate) / np.maximum(1.0 - self.rate, 1e-9))
        best = int(np.argmax(real))
        total = real.sum()
        return self.langs[best], float(real[best] / total) if total > 0 else 1.0 / len(self.langs)


def train(docs: DataFrame) -> Filters:
    counts = count_grams(docs)
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rows = counts.join(total, "lang").where(F.col("n") >= F.col("total") * SHARE)
    kept = rows.groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect()  # at most 1 / SHARE a language
    return Filters({r["lang"]: np.array(r["grams"], np.int64) for r in kept})


def language_table(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents that are not held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    filters = docs.sparkSession.sparkContext.broadcast(train(docs.where(~held)))

    def make():
        f = filters.value

        def step(x: dict) -> dict:
            said = [f.predict(t) for t in x["text"]]
            return {"doc_id": x["doc_id"], "held_out": x["held_out"], "lang_pred": [s[0] for s in said], "score": [s[1] for s in said]}

        return step

    return map_rows(docs.select("doc_id", "text", held.alias("held_out")), make, "doc_id long, held_out boolean, lang_pred string, score double")
