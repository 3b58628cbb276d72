"""Statistics of whole texts that the quality operators learn from.

One Arrow map; a row comes out for each row in.  Null text counts as empty.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, columns, free_memory, map_rows

_WORD = re.compile(WORD)
#: The characters that count as symbols.
_SYMBOL = re.compile(r"[#*$%&|<>]")
_UPPER, _LETTER, _DIGIT = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[^\W\d_]"), re.compile(r"[0-9]")
_ENDS = (".", "!", "?", ",", ";", ":", '"', ")")
WINDOW = 5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ratios, so that long and short texts compare.
RATIOS = (
    "log_words", "mean_word", "symbols_per_word", "dup_lines", "repeat_words", "upper", "letters", "digits", "unique_words",
    "words_per_line", "end_marks", "bangs", "long_words", "top_word", "bare_words",
)


def repeat_words(words: list[str]) -> int:
    """Words inside a 5-word window that is found twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) == n:
        return 0
    counts = Counter(windows)
    total, done = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + WINDOW - max(done, i)
            done = i + WINDOW
    return total


@cache
def _letter_table() -> np.ndarray:
    """Whether each of the first 65,536 code points is a letter, from the pattern itself."""
    return np.array([bool(_LETTER.match(chr(k))) for k in range(1 << 16)])


def count_letters(text: str) -> int:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = cp < 1 << 16
    if low.all():
        return int(np.count_nonzero(_letter_table()[cp]))
    return int(np.count_nonzero(_letter_table()[cp[low]])) + len(_LETTER.findall("".join(map(chr, cp[~low].tolist()))))


def measure(text: str | None) -> tuple:
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = len(_SYMBOL.findall(text))
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    dup = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    letters = count_letters(text)
    counts = Counter(words)
    d = max(n, 1)
    return (
        n, chars, symbols, dup, repeats,
        math.log2(n + 1), chars / d, symbols / d, dup / max(len(lines), 1), repeats / d,
        len(_UPPER.findall(text)) / max(letters, 1), letters / max(chars, 1), len(_DIGIT.findall(text)) / max(chars, 1), len(counts) / d,
        n / max(len(lines), 1), sum(w.endswith(_ENDS) for w in words) / d, text.count("!") / d, sum(len(w) > 12 for w in words) / d,
        max(counts.values(), default=0) / d, sum(not w[0].isalnum() for w in words) / d,
    )


def stat_table(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts of BASE (long) and the ratios of RATIOS (double)."""
    names = (*BASE, *RATIOS)

    def make():
        def step(x: dict) -> dict:
            rows = [measure(t) for t in x["text"]]
            return {"doc_id": x["doc_id"], **{c: [r[k] for r in rows] for k, c in enumerate(names)}}

        return step

    return map_rows(columns(docs, "doc_id", "text"), make, f"doc_id long, {_TYPES}")


_TYPES = ", ".join(f"{c} {t}" for names, t in ((BASE, "long"), (RATIOS, "double")) for c in names)


def measured(text: Column) -> Column:
    """A struct of BASE and RATIOS beside the row, which itself does not go to Python."""

    def run(texts: pa.Array) -> pa.Array:
        rows = [measure(t.as_py()) for t in texts]
        free_memory()
        columns_ = list(zip(*rows)) or [()] * len((*BASE, *RATIOS))
        arrays = [pa.array(c, pa.int64() if k < len(BASE) else pa.float64()) for k, c in enumerate(columns_)]
        return pa.StructArray.from_arrays(arrays, [*BASE, *RATIOS])

    return F.arrow_udf(run, _TYPES).asNondeterministic()(text)
