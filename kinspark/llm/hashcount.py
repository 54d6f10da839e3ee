"""Sums of hashes over a table, by chunks of the hash space, and bitmaps of those that are frequent."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm.common import text_slices, to_batch

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a hash that are told apart within a chunk.
_LOW = 32


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits spread."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _placed(slots: np.ndarray, bits: int) -> np.ndarray:
    return (slots * _ODD) >> np.uint64(64 - bits)


class Bitmap:
    """Bits of slots, the upper bits of hashes; a hash whose slot's bit is not set was never added.

    A slot has the bits of its chunk and ``low`` more, 32 at most.
    """

    def __init__(self, bits: int, chunks: int, low: int = _LOW):
        self.bits, self.chunks, self.low, self.map = bits, chunks, low, np.zeros(1 << (bits - 6), np.int64)

    def __getstate__(self) -> tuple:
        """Few bits are set, so what every machine gets and keeps as a file is compressed."""
        return self.bits, self.chunks, self.low, pa.compress(self.map.tobytes(), codec="zstd", asbytes=True)

    def __setstate__(self, state: tuple) -> None:
        self.bits, self.chunks, self.low, data = state
        self.map = np.frombuffer(pa.decompress(data, 1 << (self.bits - 3), codec="zstd", asbytes=True), np.int64)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.low - self.chunks)

    def place(self, slots: np.ndarray) -> np.ndarray:
        return _placed(slots, self.bits)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = self.place(self.slots(hashes))
        return (self.map[at >> np.uint64(6)].view(np.uint64) >> (at & np.uint64(63))) & np.uint64(1) == 1

    def with_slots(self, rows: DataFrame, slots_of: Callable[[pa.RecordBatch], np.ndarray] = lambda batch: batch.column(0).to_numpy(zero_copy_only=False)) -> Bitmap:
        """This bitmap with the slots of ``rows`` (one long column, or what ``slots_of`` makes of a batch); what comes to the driver is bounded by the bitmap's size.

        ``rows`` should need no Python: two such steps in a row are two workers for each core, and later steps go round all of them.
        """
        out, schema = Bitmap(self.bits, self.chunks, self.low), pa.schema([("at", pa.int64()), ("bits", pa.int64())])
        placed = partial(_placed, bits=self.bits)  # tasks need no map

        def run(batches):
            for batch in batches:
                place = placed(slots_of(batch).astype(np.uint64))
                yield to_batch(schema, at=(place >> np.uint64(6)).astype(np.int64), bits=(np.uint64(1) << (place & np.uint64(63))).view(np.int64))

        got = rows.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
        out.map[:] = self.map
        out.map[got.column("at").to_numpy()] |= got.column("bits").to_numpy()
        return out


def bitmap_bits(n: int, most: int = 28, places: int = 64) -> int:
    """Bits of a bitmap for n slots: so many places each, or more, and 2 to the ``most`` places at most (28: 32 MB)."""
    return min(most, max(20, (places * n).bit_length()))


def chunk_bits(n: int) -> int:
    """So many chunks, as a power of two, that each has about a million of n entries, of 2 to the 32 that it can tell apart."""
    return min(31, max(3, (n >> 20).bit_length()))


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte of all of them, compressed: upper bytes of small numbers take no room."""
    return pa.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of :func:`packed`."""
    return np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n).T.copy().view("<u4").ravel()


def frequent_slots(texts: DataFrame, hashes: Callable[[pa.RecordBatch], list[np.ndarray]], chunks: int, least: int, slice_bytes: int = 4 << 20, low: int = _LOW, most_held: int = 1 << 20) -> DataFrame:
    """(slot, n): how often slots occur, of those that occur ``least`` times or more; n is exact up to 2 to the 32 a task.

    ``hashes`` gives the 64-bit hashes of a slice of ``texts``, whose first column is the text.  A task holds some ``most_held`` slots of
    its slices, the equal ones summed, and sends them as one packed row a chunk: differences of slots in their order, and numbers.
    """
    schema = pa.schema([("chunk", pa.int64()), ("size", pa.int32()), ("slots", pa.binary()), ("counts", pa.binary())])
    known = Bitmap(20, chunks, low)

    def summed_slots(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        slots, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(slots)
        slots = slots[order]
        at = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
        return slots[at], np.minimum(np.add.reduceat(n[order].astype(np.int64), at), 0xFFFFFFFF).astype(np.uint32)

    def sent(slots: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        chunk = (slots >> np.uint64(low)).astype(np.int64)
        at = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
        ends = np.r_[at[1:], len(slots)]
        steps = np.diff(slots, prepend=slots[:1])
        steps[at] = slots[at] & np.uint64((1 << low) - 1)
        rows = list(zip(at.tolist(), ends.tolist(), strict=True))
        return to_batch(schema, chunk=chunk[at], size=(ends - at).astype(np.int32), slots=[packed(steps[i:j]) for i, j in rows], counts=[packed(n[i:j]) for i, j in rows])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for part in text_slices(batch, 0, most_bytes=slice_bytes):
                found = [known.slots(h) for h in hashes(part)]
                if not sum(map(len, found)):
                    continue
                slots, n = np.unique(np.concatenate(found), return_counts=True)
                parts.append((slots, n.astype(np.uint32)))
                held += len(slots)
                if held >= most_held:
                    parts = [summed_slots(parts)]
                    held = len(parts[0][0])
                    if held >= most_held // 2:  # few were equal
                        yield sent(*parts[0])
                        parts, held = [], 0
        if parts:
            yield sent(*summed_slots(parts))

    def summed(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("size", "slots", "counts")), strict=True))
        slots, n = summed_slots([(np.cumsum(unpacked(s, k), dtype=np.int64), unpacked(c, k)) for k, s, c in rows])
        many, base = n >= least, int(table.column("chunk")[0].as_py()) << low
        return pa.table({"slot": pa.array(slots[many] + base), "n": pa.array(n[many].astype(np.int64))})

    return texts.mapInArrow(run, "chunk long, size int, slots binary, counts binary").groupBy("chunk").applyInArrow(summed, "slot long, n long")
