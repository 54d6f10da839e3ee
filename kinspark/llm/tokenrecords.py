"""Token ids as length-delimited binary records with masked checksums, and an offset index beside them.

Record file: records one after the other, each

    u64 length of data | u32 masked checksum of those eight bytes | data | u32 masked checksum of data

all little-endian.  Data: u8 flags (bit 0: the id is not null), u8 bytes per token id (2 or 4), i64 document
id, then the token ids.  Index file: for each record i64 document id, u64 offset, u64 length of the record,
so that a reader in shuffled order can seek to any record.  A masked checksum is CRC-32 rotated right by 15
bits plus a constant, so that a checksum over data that itself holds checksums stays meaningful.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinspark.llm.common import columns_of, scratch_path, stored, text_slices, to_batch
from kinspark.llm.pretokens import load_tokenizer, piece_cache

_HEAD, _DATA, _INDEX, _SUM = struct.Struct("<QI"), struct.Struct("<BBq"), struct.Struct("<qQQ"), struct.Struct("<I")
# Fixed value: the constant that is added to a rotated checksum in length-delimited record files.
_MASK_DELTA = 0xA282EAD8


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + _MASK_DELTA) & 0xFFFFFFFF


def pack_record(doc_id: int | None, ids: bytes, width: int) -> bytes:
    data = _DATA.pack(doc_id is not None, width, doc_id or 0) + ids
    length = struct.pack("<Q", len(data))
    return length + _SUM.pack(masked_crc(length)) + data + _SUM.pack(masked_crc(data))


def unpack_record(record: bytes) -> tuple[int | None, np.ndarray]:
    """Document id and ids (u32) of one whole record; a wrong length or checksum is an error."""
    length, head_sum = _HEAD.unpack_from(record)
    data = record[_HEAD.size : -_SUM.size]
    if masked_crc(record[:8]) != head_sum or len(data) != length or masked_crc(data) != _SUM.unpack_from(record, len(record) - 4)[0]:
        raise ValueError("damaged token record")
    known, width, doc_id = _DATA.unpack_from(data)
    return (doc_id if known else None), np.frombuffer(data, f"<u{width}", offset=_DATA.size).astype("<u4")


class _Shard:
    """One record file and its index, written under names that no other attempt of a task uses."""

    def __init__(self, folder: str):
        store, root = fs.FileSystem.from_uri(folder)
        self.path = f"{folder}/{uuid.uuid4().hex}"
        name = f"{root}/{self.path.rsplit('/', 1)[1]}"
        self.data, self.index = store.open_output_stream(f"{name}.rec"), store.open_output_stream(f"{name}.idx")
        self.bytes = self.docs = self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes, width: int) -> None:
        record = pack_record(doc_id, ids, width)
        self.data.write(record)
        self.index.write(_INDEX.pack(doc_id or 0, self.bytes, len(record)))
        self.bytes += len(record)
        self.docs += 1
        self.tokens += len(ids) // width

    def close(self) -> None:
        self.data.close()
        self.index.close()


def read_index(path: str) -> list[tuple[int, int, int]]:
    """(document id, offset, length) of each record of the shard ``path``."""
    store, root = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{root}.idx") as f:
        return list(_INDEX.iter_unpack(f.read()))


def read_records(path: str, wanted=None):
    """(document id, ids) of the records at the positions ``wanted`` (any order), or of all in file order."""
    index = read_index(path)
    store, root = fs.FileSystem.from_uri(path)
    with store.open_input_file(f"{root}.rec") as f:
        for i in range(len(index)) if wanted is None else wanted:
            f.seek(index[i][1])
            yield unpack_record(f.read(index[i][2]))


def write_token_records(
    docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, shard_bytes: int = 64 << 20
) -> DataFrame:
    """Write every document's ids, in ascending id order, to record files; return the list of shards.

    Documents are dealt by ranges of (id, hash of text, input split) and sorted within them, so a shard holds consecutive
    documents.  The split only parts rows that are equal in both, so one id that fills much of a table, null or not, is
    spread over tasks; it is the same for a row whenever a task runs again.  Columns of the result: path, first_id, task and
    part, which order the shards, n_docs, n_tokens, n_bytes; it is stored, so that no later step writes again.
    A lost task writes new files; those of the lost one are in no list.  Defined results: a null text is
    empty and gets ``end_id`` only, null ids come first, repeated rows are written one by one, an empty
    table gives no shard.  ``folder`` is a new folder in the shared checkpoint folder by default and is the
    caller's to delete.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-records")
    schema = pa.schema([("path", pa.string()), ("first_id", pa.int64()), ("task", pa.int64()), ("part", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])
    end = [] if end_id is None else [end_id]

    def run(batches):
        width = 2 if load_tokenizer(tokenizer_path).get_vocab_size() <= 1 << 16 else 4
        tail = np.array(end, dtype=f"<u{width}").tobytes()
        cache, shard, first, part = piece_cache(tokenizer_path, width, 550_000), None, None, 0
        task = TaskContext.get().partitionId()

        def row():
            shard.close()
            return to_batch(schema, path=[shard.path], first_id=[first], task=[task], part=[part], n_docs=[shard.docs], n_tokens=[shard.tokens], n_bytes=[shard.bytes])

        for batch in batches:
            for rows in text_slices(batch, 1):
                for key, ids in zip(rows.column(0).to_pylist(), cache.totals(rows.column(1)), strict=True):
                    if shard is None:
                        store, root = fs.FileSystem.from_uri(folder)
                        store.create_dir(root, recursive=True)
                        shard, first = _Shard(folder), key
                    shard.add(key, ids + tail, width)
                    if shard.bytes >= shard_bytes:
                        yield row()
                        shard, part = None, part + 1
        if shard is not None:
            yield row()

    src = columns_of(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("h"), F.spark_partition_id().alias("split"), F.col(text_col).alias("text"))
    out = src.repartitionByRange(F.col("id").asc_nulls_first(), F.col("h"), F.col("split")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("h"))
    fields = "path string, first_id long, task long, part long, n_docs long, n_tokens long, n_bytes long"
    return stored(out.select("id", "text").mapInArrow(run, fields), "token-shards")


def read_token_records(shards: DataFrame) -> DataFrame:
    """Read shards back: doc_id, start (ids of all documents before), n_tokens, ids_crc32 over u32 ids.

    One small row per shard goes through the ordered window that gives each shard its place; documents are
    read and checked in parallel, one record at a time.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    # Ranges rise with the tasks' numbers, and a task counts its parts.
    order = Window.orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.select("path", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("start"))

    def run(batches):
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for key, ids in read_records(path):
                    rows.append((key, start, len(ids), zlib.crc32(ids)))
                    start += len(ids)
                    if len(rows) == 5000:
                        yield to_batch(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))
                        rows = []
                if rows:
                    yield to_batch(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))

    return placed.repartition(max(1, min(shards.count(), 100_000))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
