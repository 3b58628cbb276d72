"""BPE encoding with reuse of content-defined chunks, and decoding.

A text is cut where a rolling hash of its last ``WINDOW`` code points says so, so passages
that documents share are cut alike and their chunks are encoded once for all documents that
a worker sees (a store of two generations with a fixed bound).  Tokens at a join of two
chunks may be wrong.  They are repaired by re-encoding a window over the join, from a place
in the chunk before it to a place in the chunk behind it, and some text more on either side;
there the window's tokens are compared with those of the chunks.  Where they differ, or one
has no token border at the place, the window grows, in the end to the whole text.

Places are chosen where encodings agree as a rule: at a space or line feed after a character
that is not white space.  No word of a byte-level pattern goes across it, so only the
comparison of tokens, not a property of the vocabulary, decides what is accepted.

A chunk that the store lacks is put together from the tokens of its words, which a worker
remembers as well; the windows always come from the library, so the comparison also holds
the two ways of encoding to each other at every join.  (Few chunks of prose are shared, and
the library alone is too slow for the limits; the README has figures.)

A special token's string in a text is that token, as in the library; texts are split there
first.  Defined cases: null and empty texts have no tokens; repeated rows repeat results; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from array import array
from bisect import bisect_left
from collections import ChainMap
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from .common import columns, map_rows

WINDOW = 16
#: A cut comes after about so many code points, and no chunk has more than ``LONGEST``.
MEAN, LONGEST = 512, 8192
#: Characters of chunks that one generation of a worker's store holds.
STORE_CHARS = 4_000_000
#: Words that a worker remembers with their tokens, and the most characters of one.
STORE_WORDS, LONGEST_WORD = 200_000, 32
#: Characters of texts that are worked on at once (one text at least).
GROUP_CHARS = 400_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

#: White space by Unicode, beyond the control characters and the space.
_WIDE_SPACE = np.array([0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


#: The vocabulary's word pattern over code points below U+0250, with its classes spelled out:
#: contractions; a letter, digit or other run with one space before it; white space, of
#: which the last one is left to the word behind it.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN_WORD = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def cuts(cp: np.ndarray) -> list[int]:
    """Ends of the chunks, the last one the text's end."""
    n = len(cp)
    ends: list[int] = []
    if n > WINDOW:
        x = cp.astype(np.uint64)
        # polynomial hash of each window by doubling: 1, 2, 4, 8, 16 code points
        h, width, m = x, 1, _MULTIPLIER
        with np.errstate(over="ignore"):
            while width < WINDOW:
                h = h[width:] + h[:-width] * m
                m = m * m
                width *= 2
            marks = np.flatnonzero(((h * _MULTIPLIER) >> np.uint64(40)) % np.uint64(MEAN) == 0) + WINDOW
        ends = marks[marks < n].tolist()
    out, at = [], 0
    for e in [*ends, n]:
        while e - at > LONGEST:
            at += LONGEST
            out.append(at)
        if e > at:
            out.append(e)
            at = e
    return out


def agreeing(cp: np.ndarray) -> np.ndarray:
    """Places where every encoding has a token border: white space behind something else."""
    before, here = cp[:-1], cp[1:]
    solid = (before > 0x20) & (before != 0x7F)
    if len(cp) and cp.max() > 0x7F:
        solid &= ~np.isin(before, _WIDE_SPACE) & ~((before > 0x7F) & (before < 0xA1))
    return np.flatnonzero(((here == 0x20) | (here == 0x0A)) & solid) + 1


class Codec:
    """A tokenizer with the store of encoded chunks; one for each worker and file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {c: b for b, c in _byte_letters().items()}
        size = self.tok.get_vocab_size()
        self.bytes = [b""] * size
        for token, i in self.tok.get_vocab(True).items():
            self.bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.lengths = [len(b) for b in self.bytes]
        self.young: dict[str, np.ndarray] = {}
        self.old: dict[str, np.ndarray] = {}
        self.held = 0
        #: words and their tokens as bytes of 32-bit integers, which join without boxing
        self.words: dict[str, bytes] = {}
        #: characters of chunks that were looked up, and of those that the store had
        self.asked = self.found = 0

    def ends(self, tokens: list[int], at: int) -> list[int]:
        """The places in bytes where tokens end, and first the place ``at`` where they begin."""
        return list(accumulate(map(self.lengths.__getitem__, tokens), initial=at))

    def known(self, piece: str) -> np.ndarray | None:
        ids = self.young.get(piece)
        if ids is None and (ids := self.old.get(piece)) is not None:
            self._keep(piece, ids)
        return ids

    def _keep(self, piece: str, ids: np.ndarray) -> None:
        self.held += len(piece)
        self.young[piece] = ids

    def turn_over(self) -> None:
        if self.held > STORE_CHARS:
            self.old, self.young, self.held = self.young, {}, 0

    def library(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids by the library, whose own results are large and held for a few only."""
        out: list[np.ndarray] = []
        for few in _groups(pieces, GROUP_CHARS // 4):
            out += [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(few, add_special_tokens=False)]
        return out

    def encode_new(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of chunks that the store lacks: Latin ones word by word, with the tokens of short
        words remembered, the others by the library as a whole."""
        if len(self.words) > STORE_WORDS:
            self.words.clear()
        split = [None if _BEYOND_LATIN.search(p) else _LATIN_WORD.findall(p) for p in pieces]
        unknown = list(set().union(*(w for w in split if w is not None)).difference(self.words))
        long: dict[str, bytes] = {}
        for few in _groups(unknown, GROUP_CHARS // 4):
            for w, e in zip(few, self.tok.encode_batch_fast(few, add_special_tokens=False)):
                (self.words if len(w) <= LONGEST_WORD else long)[w] = array("I", e.ids).tobytes()
        rest = iter(self.library([p for p, w in zip(pieces, split) if w is None]))
        known = ChainMap(self.words, long).__getitem__ if long else self.words.__getitem__
        return [next(rest) if w is None else np.frombuffer(b"".join(map(known, w)), np.uint32) for w in split]

    def encode_pieces(self, pieces: list[str]) -> dict[str, np.ndarray]:
        """Ids of each piece, encoded unless the store has them."""
        out: dict[str, np.ndarray] = {}
        new = {}
        for p in pieces:
            self.asked += len(p)
            if p in out or p in new:
                self.found += len(p)
                continue
            ids = self.known(p)
            if ids is None:
                new[p] = None
            else:
                self.found += len(p)
                out[p] = ids
        for p, ids in zip(new, self.encode_new(list(new))):
            out[p] = ids
            self._keep(p, ids)
        return out

    def segments(self, text: str) -> list[str | int]:
        """The text cut at special tokens' strings, leftmost and longest first."""
        parts: list[str | int] = [text]
        for s, i in sorted(self.special.items(), key=lambda x: -len(x[0])):
            parts = [y for p in parts for y in (_between(p.split(s), i) if isinstance(p, str) else [p])]
        return [p for p in parts if p != ""]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        return [ids for few in _groups(texts, GROUP_CHARS) for ids in self._encode_few(few)]

    def _encode_few(self, texts: list[str]) -> list[np.ndarray]:
        plans = [[Plan(p) if isinstance(p, str) else p for p in self.segments(t)] for t in texts]
        every = [p for plan in plans for p in plan if not isinstance(p, int)]
        ids = self.encode_pieces([c for p in every for c in p.chunks])
        for p in every:
            p.join()
        windows = list(dict.fromkeys(p.text[w.a : w.b] for p in every for w in p.windows))
        repairs = dict(zip(windows, self.library(windows)))
        out = []
        for plan in plans:
            parts = [np.array([p], np.uint32) if isinstance(p, int) else p.result(self, ids, repairs) for p in plan]
            out.append(np.concatenate(parts) if parts else np.zeros(0, np.uint32))
        self.turn_over()
        return out

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


def _groups(texts: list[str], chars: int) -> Iterator[list[str]]:
    """Runs of texts of about so many characters."""
    few, size = [], 0
    for t in texts:
        few.append(t)
        size += len(t)
        if size >= chars:
            yield few
            few, size = [], 0
    if few:
        yield few


def _between(parts: list[str], i: int) -> list[str | int]:
    out: list[str | int] = [parts[0]]
    for p in parts[1:]:
        out += [i, p]
    return out


class Window(NamedTuple):
    """A stretch of text over joins: ``a <= left <= right <= b``.  Its tokens from left to
    right go into the result; those before and behind must be the chunks' own."""

    a: int
    left: int
    right: int
    b: int
    first: int | None  # chunk that holds a and left; None: the window begins with the text
    last: int | None  # chunk that holds right and b; None: it ends with the text


class Plan:
    """One text: its chunks, and after ``join`` the windows that repair its joins."""

    def __init__(self, text: str):
        cp = code_points(text)
        self.text, self.ends = text, cuts(cp)
        self.starts = [0, *self.ends[:-1]]
        self.chunks = [text[a:b] for a, b in zip(self.starts, self.ends)]
        self.windows: list[Window] = []
        if len(self.chunks) > 1:
            self.places = agreeing(cp)
            # of each chunk, the range of the places strictly inside
            self.low = np.searchsorted(self.places, self.starts, "right").tolist()
            self.high = np.searchsorted(self.places, self.ends, "left").tolist()
            wide = np.concatenate(([0], np.cumsum(1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF)))) if len(text) != len(text.encode()) else None
            self.byte_at = (lambda i: int(wide[i])) if wide is not None else (lambda i: i)

    def join(self) -> None:
        """One window between each two neighbours among the chunks that have a place."""
        if len(self.chunks) < 2:
            return
        solid = [k for k in range(len(self.chunks)) if self.high[k] > self.low[k]]
        ends = [None, *solid, None]
        for k, m in zip(ends, ends[1:]):
            # the first and the last chunk are right from or to the end of the text
            if (k is None and m == 0) or (m is None and k == len(self.chunks) - 1):
                continue
            self.windows.append(self.window(k, m, 1))

    def window(self, k: int | None, m: int | None, reach: int) -> Window:
        """From the last place in chunk k to the first in chunk m, with ``reach`` places more
        on either side to compare, as far as the chunks have them."""
        at = self.places
        left = 0 if k is None else int(at[self.high[k] - 1])
        right = len(self.text) if m is None else int(at[self.low[m]])
        a = 0 if k is None else int(at[max(self.low[k], self.high[k] - 1 - reach)])
        b = len(self.text) if m is None else int(at[min(self.high[m] - 1, self.low[m] + reach)])
        return Window(a, left, right, b, k, m)

    def accept(self, w: Window, got: list[int], codec: Codec, held: dict[int, tuple[list, list]]) -> list[int] | None:
        """The window's tokens from left to right if its other tokens are the chunks' own."""
        ends = codec.ends(got, self.byte_at(w.a))
        i, j = _border(ends, self.byte_at(w.left)), _border(ends, self.byte_at(w.right))
        if i is None or j is None:
            return None
        for k, x, y, own in ((w.first, w.a, w.left, got[:i]), (w.last, w.right, w.b, got[j:])):
            if k is not None:
                tokens, borders = held[k]
                p, q = _border(borders, self.byte_at(x)), _border(borders, self.byte_at(y))
                if p is None or q is None or tokens[p:q] != own:
                    return None
        return got[i:j]

    def result(self, codec: Codec, ids: dict[str, np.ndarray], repairs: dict[str, np.ndarray]) -> np.ndarray:
        if len(self.chunks) < 2:
            return ids[self.chunks[0]] if self.chunks else np.zeros(0, np.uint32)
        held: dict[int, tuple[list, list]] = {}
        for k in {k for w in self.windows for k in (w.first, w.last) if k is not None}:
            tokens = ids[self.chunks[k]].tolist()
            held[k] = tokens, codec.ends(tokens, self.byte_at(self.starts[k]))
        out: list[int] = []
        at, inside = 0, 0  # settled up to here, and the chunk that goes on from here
        for w in self.windows:
            got = self.accept(w, repairs[self.text[w.a : w.b]].tolist(), codec, held)
            reach = 1
            while got is None:
                reach *= 4
                wider = self.window(w.first, w.last, reach)
                if (wider.a, wider.b) == (w.a, w.b):
                    return codec.library([self.text])[0]
                w = wider
                got = self.accept(w, codec.library([self.text[w.a : w.b]])[0].tolist(), codec, held)
            if w.left > at:
                out += self._own(held[w.first], at, w.left)
            out += got
            at, inside = w.right, w.last
        if at < len(self.text):
            out += self._own(held[inside], at, len(self.text))
        return np.array(out, np.uint32)

    def _own(self, chunk: tuple[list, list], a: int, b: int) -> list[int]:
        """The chunk's tokens between two places that are borders of it."""
        tokens, borders = chunk
        return tokens[_border(borders, self.byte_at(a)) : _border(borders, self.byte_at(b))]


def _border(ends: list[int], at: int) -> int | None:
    i = bisect_left(ends, at)
    return i if i < len(ends) and ends[i] == at else None


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: bytes that
    print stand for themselves, the others for code points from 256 on, in order."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in prints}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return out


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _maker(path: str | None, finish):
    def make():
        c = codec(path or default_path())

        def step(x: dict) -> dict:
            texts = [t or "" for t in x["text"]]
            return finish(c, x, c.encode_batch(texts))

        return step

    return make


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids for every document.  ``path`` is a tokenizer file on every worker."""
    make = _maker(path, lambda c, x, ids: {"doc_id": x["doc_id"], "ids": [i.tolist() for i in ids]})
    return map_rows(columns(docs, "doc_id", "text"), make, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    def make():
        c = codec(path or default_path())
        return lambda x: {"doc_id": x["doc_id"], "text": [c.decode(np.array(i or [], np.uint32)) for i in x["ids"]]}

    return map_rows(columns(encoded, "doc_id", "ids"), make, "doc_id long, text string")


def _digest(c: Codec, x: dict, ids: list[np.ndarray]) -> dict:
    little = (lambda a: a) if sys.byteorder == "little" else (lambda a: a.byteswap())
    return {
        "doc_id": x["doc_id"],
        "n_tokens": [len(i) for i in ids],
        "ids_sha256": [hashlib.sha256(little(i).tobytes()).hexdigest() for i in ids],
        "decoded_sha256": [hashlib.sha256(c.decode(i).encode()).hexdigest() for i in ids],
    }


def token_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them.

    One map without a shuffle; ids and decoded texts never leave their task.
    """
    return map_rows(columns(docs, "doc_id", "text"), _maker(path, _digest), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
