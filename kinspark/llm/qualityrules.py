"""Quality rules: fixed counts of each text, and a likelihood ratio of hashed n-grams.

Two multinomials over buckets of hashed words and word pairs, one from trusted documents and one from the whole
corpus; a document's log-likelihood ratio over its number of n-grams says how much more it is like what is
trusted than like the corpus.  Every document is judged by the same threshold; nothing is drawn at random.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm.common import SLICE_ROWS, columns_of, text_slices, to_batch

_SYMBOLS = "#*$%&|<>"
# White space that parts words; other white space belongs to words.
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def word_ids(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """A number for each word, equal for equal words, and the distinct words in the order of their numbers."""
    numbers: dict[bytes, int] = {}
    ids = [numbers.setdefault(w, len(numbers)) for w in words]
    return np.array(ids, dtype=np.int64), list(numbers)


def repeated_words(ids: np.ndarray, window: int = 8) -> int:
    """How many words lie in a window of ``window`` (a power of two) words that the text holds twice or more.

    Windows get exact numbers by doubling: equal pairs of words get one number, equal pairs of pairs one, and so on.
    """
    if len(ids) <= window:
        return 0
    width = 1
    while width < window:
        pair = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
        ids = np.unique(pair, return_inverse=True)[1]
        width *= 2
    twice = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edge = np.zeros(len(ids) + window, dtype=np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; a null one has none."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(_BLANKS):
            dup += line in seen
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, _BLANKS)), sum(map(text.count, _SYMBOLS)), dup, repeated_words(word_ids(words)[0])


class _Hashes(dict):
    """The hash of each word met; begins anew after ``most`` words, so memory is bounded."""

    most = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = int.from_bytes(hashlib.md5(word, usedforsecurity=False).digest()[:4], "big")
        return found


_HASHES = _Hashes()


def ngram_buckets(text: str | None, bits: int) -> np.ndarray:
    """The buckets of a text's words (A-Z in lower case) and word pairs, repeats included.

    A word's hash is the first four bytes of its MD5, which SQL has too; hashes of pairs and buckets are products of it.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    ids, distinct = word_ids(words)
    h = np.fromiter(map(_HASHES.__getitem__, distinct), np.uint32, len(distinct))[ids]
    pair = (h[:-1] * np.uint32(0x85EBCA6B)) ^ (h[1:] + np.uint32(0x27D4EB2F))
    both = np.concatenate([h, pair]) * np.uint32(0x9E3779B1)
    return (both >> np.uint32(32 - bits)).astype(np.int64)


@dataclass
class RatioModel:
    """log(trusted / raw) of each bucket."""

    ratio: np.ndarray
    bits: int

    def score(self, text: str | None) -> float | None:
        """Mean log ratio of the text's n-grams; none without words."""
        at = ngram_buckets(text, self.bits)
        return float(self.ratio[at].mean()) if len(at) else None


def fit_ratio(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 14, most_broadcast: int = 1_000_000, smooth: float = 0.5) -> RatioModel:
    """Count n-grams of all documents, and of all those whose id is among ``trusted``.

    Trusted ids are counted first: up to ``most_broadcast`` are broadcast and texts stay where they are, more are joined by a
    shuffle; the counts are the same.  Each task sends one count per bucket; the driver gets 2 to the ``bits`` rows.
    A document with a null id is never trusted, repeated ids in ``trusted`` count once, repeated documents each time; null
    and empty texts have no n-grams; an empty table, or nothing trusted, gives a model that judges nothing.
    """
    ids = trusted.select(F.col(id_col).alias("_id")).where("_id is not null").distinct()
    small = ids.count() <= most_broadcast
    schema = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])

    def run(batches):
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            for part in text_slices(batch, 0, rows=SLICE_ROWS):
                for text, good in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    n = np.bincount(ngram_buckets(text, bits), minlength=1 << bits)
                    raw += n
                    if good:
                        target += n
        some = np.flatnonzero(raw)
        yield to_batch(schema, bucket=some, raw=raw[some], target=target[some])

    src = columns_of(docs, id_col, text_col)
    if small:
        marked = src.join(F.broadcast(ids), F.col(id_col) == F.col("_id"), "left").select(text_col, F.col("_id").isNotNull().alias("good"))
    else:  # documents without an id would all meet in one task
        joined = src.where(F.col(id_col).isNotNull()).join(ids.hint("merge"), F.col(id_col) == F.col("_id"), "left")
        marked = joined.select(text_col, F.col("_id").isNotNull().alias("good")).unionByName(src.where(F.col(id_col).isNull()).select(text_col, F.lit(False).alias("good")))
    got = marked.mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.full(1 << bits, smooth), np.full(1 << bits, smooth)
    for bucket, r, t in got:
        raw[bucket] += r
        target[bucket] += t
    if target.sum() == smooth * len(target):
        return RatioModel(np.zeros(1 << bits), bits)  # nothing is trusted: nothing is judged
    return RatioModel(np.log(target / target.sum()) - np.log(raw / raw.sum()), bits)


def judge(docs: DataFrame, model: RatioModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = -0.1) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, base_failed, log_ratio, kept.

    base_failed: under 20 words, or over 30 % of words in repeated windows.  kept: not failed and log_ratio at least
    ``threshold``.  A null or empty text has no words, so it fails; its log_ratio is null.  Null ids and repeated
    rows have their rows; an empty table gives an empty result; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = pa.schema([("id", pa.int64()), *((n, pa.int64()) for n in names), ("base_failed", pa.bool_()), ("log_ratio", pa.float64()), ("kept", pa.bool_())])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 1, rows=SLICE_ROWS):
                texts = part.column(1).to_pylist()
                base = [base_counts(t) for t in texts]
                failed = [b[0] < 20 or 100 * b[4] > 30 * b[0] for b in base]
                ratio = [sent.value.score(t) for t in texts]
                kept = [not f and r is not None and r >= threshold for f, r in zip(failed, ratio, strict=True)]
                columns = dict(zip(names, zip(*base, strict=True), strict=True))
                yield to_batch(schema, id=part.column(0), **columns, base_failed=failed, log_ratio=ratio, kept=kept)

    fields = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, log_ratio double, kept boolean"
    return columns_of(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, fields).withColumnRenamed("id", id_col)
