"""Token counts by a map-side lookup in two tiers, without a shuffle of pre-tokens."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm.common import columns_of, text_slices, to_batch
from kinspark.llm.pretokens import load_tokenizer, piece_cache, piece_of, pieces_of


def frequent_lengths(docs: DataFrame, tokenizer_path: str, text_col: str = "text", entries: int = 20_000, sample_docs: int = 400, longest: int = 20_000) -> bytes:
    """The compact table of tier one: lengths of pre-tokens that are worth sending to every worker.

    It is a cache and no statistic: it decides where a length is looked up, never what the length is.  At
    most ``entries`` pieces are taken from at most ``sample_docs`` documents of at most ``longest`` bytes, so what the driver
    gets and sends has a fixed bound.  Without such documents the table is empty and the workers' caches do all.
    Layout: one byte of length and the piece, with a zero byte between pieces (no piece holds one there).
    """
    seen: Counter[str] = Counter()
    short = F.col(text_col).isNotNull() & (F.octet_length(text_col) <= longest)
    for (text,) in columns_of(docs, text_col).where(short).take(sample_docs):  # reads no more partitions than it needs
        seen.update(p for p in pieces_of(text)[:-1] if len(p) <= 40 and "\0" not in p)
    t = load_tokenizer(tokenizer_path)
    top = sorted(seen, key=lambda p: (-seen[p], p))[:entries]
    lengths = [len(e.ids) for e in t.encode_batch_fast([piece_of(k) for k in top], add_special_tokens=False)]
    return b"\0".join(bytes([n]) + p.encode() for p, n in zip(top, lengths, strict=True) if 0 < n < 256)


def _unpack(table: bytes) -> dict[str, int]:
    return {x[1:].decode(): x[0] for x in table.split(b"\0") if x}


def count_tokens(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit_tokens: int = 1024, sample_docs: int = 400
) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_bytes``, ``n_tokens``, ``over_limit``.

    Tier one is a broadcast table of frequent pieces, tier two each worker's own bounded cache; what neither
    has is encoded by the tokenizers library.  Nothing is shuffled.  Defined results: a null or empty text
    has 0 bytes and 0 tokens; a null id is kept; repeated rows are counted one by one; an empty table gives
    an empty result; other columns are not read.  Texts are never cut short or counted in parts.
    """
    src = columns_of(docs, id_col, text_col)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, tokenizer_path, text_col, sample_docs=sample_docs))
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        cache = piece_cache(tokenizer_path)
        cache.seed(_unpack(table.value))
        for batch in batches:
            for part in text_slices(batch, 1, rows=1024):
                n = cache.totals(part.column(1))
                n_bytes = pc.fill_null(pc.binary_length(part.column(1)), 0)
                yield to_batch(schema, id=part.column(0), n_bytes=n_bytes.cast(pa.int64()), n_tokens=n, over_limit=[x > limit_tokens for x in n])

    out = src.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
