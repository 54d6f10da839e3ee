"""Byte-level BPE through caches of pre-tokens, with results equal to the tokenizers library.

A text is cut before every single space that a non-space follows.  The pre-tokenizer of byte-level BPE
never joins characters over such a place: a space begins a pre-token there, since a run of white space
gives its last space to the word behind it.  So ids of a text are the ids of its pieces in order, and most
pieces have been seen before.  Unknown pieces of many texts are encoded together by the library.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CUT = re.compile(r"(?= \S)")
#: A space that is not before a word.
_ODD = re.compile(r" (?:\s|\Z)")
#: The same, and more than it, for Arrow's regular expressions.
_ODD_RE2 = r" (?:[\s\v\x1c-\x1f\x{85}\pZ]|\z)"


@lru_cache(maxsize=2)
def load_tokenizer(path: str):
    """The library's tokenizer; one for each worker process."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pieces_of(text: str) -> list[str]:
    """Keys of the pieces of a text in order.  An empty text has none.

    The key of a piece that is a space and a word without spaces is the word; the key of any other piece is a space
    and the piece.  So most texts are cut by a plain split at spaces.
    """
    if not text:
        return []
    if _ODD.search(text):
        return [p[1:] if p[0] == " " and len(p) > 1 and " " not in p[1:] else " " + p for p in _CUT.split(text) if p]
    out = text.split(" ")
    out[0] = " " + out[0]
    return out


def piece_of(key: str) -> str:
    """The piece of a key."""
    return key[1:] if key[0] == " " else " " + key


@lru_cache(maxsize=2)
def _is_cuttable(path: str) -> bool:
    """Whether the tokenizer is byte-level BPE of the kind described above, so cutting is exact."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return (
        spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and spec["model"]["type"] == "BPE"
        and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or " " in t["content"] for t in spec["added_tokens"])
    )


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> np.ndarray:
    """Length in bytes of each id's text.  One character of a vocabulary entry is one byte of text."""
    t = load_tokenizer(path)
    out = np.zeros(t.get_vocab_size(with_added_tokens=True), dtype=np.int64)
    for word, i in t.get_vocab(with_added_tokens=True).items():
        out[i] = len(word)
    for i, added in t.get_added_tokens_decoder().items():
        out[i] = len(added.content.encode())
    return out


class _Known(dict):
    """Values by key; a key without one is noted in ``unknown`` and gives None."""

    def __init__(self, *args):
        super().__init__(*args)
        self.unknown: list[str] = []

    def __missing__(self, key):
        self.unknown.append(key)


class PieceCache:
    """The number of ids of each piece (``width`` 0), or its ids as bytes, ``width`` little-endian bytes each.

    Pieces are kept until there are ``limit``; as words of prose come in order of their frequency, these are the frequent
    ones.  From then on the others are encoded each time.  If their share grows to well over what it was at first, the
    texts have changed, and the cache starts anew.  Memory is bounded, results never depend on it.
    """

    def __init__(self, path: str, width: int = 0, limit: int = 400_000):
        self.path, self.width, self.limit = path, width, limit
        self.fixed, self.known = {}, _Known()
        self.seen = self.missed = 0  # pieces since the cache is full
        self.usual: float | None = None  # share of missed ones at first
        self.exact_cuts = _is_cuttable(path)

    def _values(self, ids: np.ndarray, stops: list[int]) -> list:
        """The values of consecutive runs of ids that end at ``stops``."""
        starts = [0, *stops[:-1]]
        if not self.width:
            return [b - a for a, b in zip(starts, stops, strict=True)]
        w, raw = self.width, ids.astype(f"<u{self.width}").tobytes()
        return [raw[a * w : b * w] for a, b in zip(starts, stops, strict=True)]

    def _encode(self, keys: list[str]) -> dict:
        """The value of each key's piece.  Words behind spaces are encoded as one text, then parted by bytes."""
        t, out, alone, joined = load_tokenizer(self.path), {}, [], []
        for k in keys:
            (alone if k[0] == " " else joined).append(k)
        for at in range(0, len(joined), 4000):
            part = joined[at : at + 4000]
            ids = np.array(t.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, dtype=np.int64)
            ends = np.cumsum([len(k.encode()) + 1 for k in part])
            stops = np.searchsorted(np.cumsum(_token_bytes(self.path)[ids]), ends) + 1
            out.update(zip(part, self._values(ids, stops.tolist()), strict=True))
        for at in range(0, len(alone), 1000):
            part = alone[at : at + 1000]
            for k, e in zip(part, t.encode_batch_fast([k[1:] for k in part], add_special_tokens=False), strict=True):
                out[k] = self._values(np.array(e.ids, dtype=np.int64), [len(e.ids)])[0]
        return out

    def _lookup(self, keys: list[str]) -> list:
        """The values of keys."""
        known = self.known
        look, unknown = known.__getitem__, known.unknown
        out = list(map(look, keys))
        full, missed = len(known) >= self.limit, len(unknown)
        if missed:
            new = list(dict.fromkeys(unknown))
            unknown.clear()
            known.update(self._encode(new))
            out = list(map(look, keys))
            for k in new:
                if full or len(k) > 40:  # a piece longer than any word of prose is hardly met again
                    del known[k]
        if full:
            self._watch(len(keys), missed)
        return out

    def values(self, texts: list[str | None]) -> list[list]:
        """For each text the values of its pieces in order; null counts as the empty text."""
        cut = [(pieces_of(x) if self.exact_cuts else [" " + x]) if x else [] for x in texts]
        found = iter(self._lookup([k for keys in cut for k in keys]))
        return [list(islice(found, len(keys))) for keys in cut]

    def totals(self, texts: pa.Array) -> list:
        """For each text the sum of its pieces' numbers of ids, or its ids as bytes.

        Texts without doubled or trailing white space are split and numbered by Arrow, so that Python only
        meets the distinct words of a batch; their values are put in place by one gather.
        """
        odd = pc.or_(pc.is_null(texts), pc.fill_null(pc.or_(pc.match_substring_regex(texts, _ODD_RE2), pc.equal(texts, "")), True))
        if not self.exact_cuts:
            odd = pa.array(np.ones(len(texts), dtype=bool))
        odd = odd.to_numpy(zero_copy_only=False)
        out: list = [0 if not self.width else b""] * len(texts)
        at = np.flatnonzero(odd)
        for i, v in zip(at.tolist(), self.values(texts.take(pa.array(at)).to_pylist()), strict=True):
            out[i] = b"".join(v) if self.width else sum(v)
        at = np.flatnonzero(~odd)
        if not len(at):
            return out
        lists = pc.split_pattern(texts.take(pa.array(at)), " ")
        edge = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        words = lists.flatten()
        numbered = words.dictionary_encode()
        # The first word of a text has no space before it: it gets a key of its own.
        first = words.take(pa.array(edge[:-1])).to_pylist()
        keys = [w or " " for w in numbered.dictionary.to_pylist()] + [" " + w for w in first]
        place = numbered.indices.to_numpy().astype(np.int64)
        place[edge[:-1]] = len(numbered.dictionary) + np.arange(len(first))
        values = self._lookup(keys)
        if not self.width:
            ends = np.concatenate([[0], np.cumsum(np.array(values, dtype=np.int64)[place])])[edge]
            sums = np.diff(ends).tolist()
            for i, n in zip(at.tolist(), sums, strict=True):
                out[i] = n
            return out
        size = np.array([len(v) for v in values], dtype=np.int64) // self.width
        begin, own = np.cumsum(size) - size, size[place]
        stop = np.cumsum(own)
        ids = np.frombuffer(b"".join(values), f"<u{self.width}")
        gathered = ids[np.repeat(begin[place] - (stop - own), own) + np.arange(int(stop[-1]))].tobytes()
        ends = (np.concatenate([[0], stop])[edge] * self.width).tolist()
        for i, a, b in zip(at.tolist(), ends, ends[1:], strict=False):
            out[i] = gathered[a:b]
        return out

    def _watch(self, seen: int, missed: int, window: int = 2_000_000) -> None:
        """Count misses of the full cache; start anew once their share has grown by half."""
        self.seen, self.missed = self.seen + seen, self.missed + missed
        if self.seen >= window:
            share = self.missed / self.seen
            if self.usual is None:
                self.usual = share
            elif share > 1.5 * self.usual + 0.01:
                self.known, self.usual = _Known(self.fixed), None
            self.seen = self.missed = 0

    def seed(self, fixed: dict) -> None:
        """Values that are there from the start; the first such set stays."""
        if not self.fixed:
            self.fixed = fixed
            self.known.update(fixed)


@lru_cache(maxsize=2)
def piece_cache(path: str, width: int = 0, limit: int = 400_000) -> PieceCache:
    """The cache of this worker process; it lives on from task to task.

    Some 200 bytes for each of ``limit`` pieces.
    """
    return PieceCache(path, width, limit)
