"""Packing token ids into windows by multiway differencing.

Full windows are cut off long documents.  The rests are packed in groups by the Karmarkar-Karp method for
many subsets: each rest starts as a partition of its own; the two partitions of largest imbalance are merged again
and again, the fullest slot of one with the emptiest of the other, so imbalances cancel.
What remains is one partition with slots of nearly equal sums, the windows.  When a slot is over capacity
the number of windows rises and the group is packed anew.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm.common import columns_of, text_slices, to_batch
from kinspark.llm.pretokens import piece_cache

#: Sequence ids hold the task above this bit and the task's own count below it.
_TASK_BIT = 36


def _merged(a: np.ndarray, ha: np.ndarray, b: np.ndarray, hb: np.ndarray, follow: list[int], tail: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Two partitions as one: the fullest slot of one with the emptiest of the other."""
    b, hb = b[::-1], hb[::-1]
    sums, heads = a + b, np.where(ha < 0, hb, ha)
    both = np.flatnonzero((ha >= 0) & (hb >= 0))
    for x, y in zip(ha[both].tolist(), hb[both].tolist(), strict=True):
        follow[tail[x]] = y
        tail[x] = tail[y]
    order = np.argsort(sums, kind="stable")
    sums = sums[order]
    return sums - sums[0], heads[order]


def _placed(sums: np.ndarray, heads: np.ndarray, follow: list[int], tail: list[int], item: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A partition after an item has gone to its emptiest slot."""
    head, total = int(heads[0]), int(sums[0]) + size
    if head < 0:
        head = item
    else:
        follow[tail[head]] = item
        tail[head] = item
    at = int(np.searchsorted(sums[1:], total))
    sums = np.concatenate([sums[1 : at + 1], [total], sums[at + 1 :]])
    return sums - sums[0], np.concatenate([heads[1 : at + 1], [head], heads[at + 1 :]])


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indexes of ``sizes`` in k subsets of nearly equal sums, by largest-differencing of k-part partitions.

    Each item starts as a partition of its own, and len(sizes) - 1 merges make one of all.  A partition is its slot sums
    relative to the least, rising, and the first item of each slot; its imbalance is the largest of the sums.  Of equal
    imbalances the partition made last comes first, then single items in falling order.  While a partition has empty slots its
    imbalance is its largest item's, so it meets single items one after the other, each in an empty slot: these merges are
    done at one go.
    """
    if k == 1:
        return [list(range(len(sizes)))]
    follow, tail, size = [-1] * len(sizes), list(range(len(sizes))), np.array(sizes, dtype=np.int64)
    falling = np.argsort(-size, kind="stable")
    weight = size[falling]
    heap, at, n = [], 0, 0  # merged partitions; the next single item; merged partitions so far

    def push(sums: np.ndarray, heads: np.ndarray) -> None:
        nonlocal n
        n += 1
        heapq.heappush(heap, (-int(sums[-1]), -n, sums, heads))

    def next_is_single() -> bool:
        return at < len(weight) and (not heap or weight[at] > -heap[0][0])

    while True:
        if next_is_single():
            # A new partition from the next item and those that come before all merged partitions, while it has empty slots.
            few = min(k, max(1, int(np.searchsorted(-weight[at:], heap[0][0])) if heap else len(weight) - at))
            sums, heads = np.zeros(k, np.int64), np.full(k, -1, np.int64)
            sums[k - few :], heads[k - few :] = weight[at : at + few][::-1], falling[at : at + few][::-1]
            at += few
            if few < k or not heap and at == len(weight):
                if heap:
                    _, _, b, hb = heapq.heappop(heap)
                    sums, heads = _merged(sums, heads, b, hb, follow, tail)
                elif at == len(weight):
                    break
            push(sums - sums[0], heads)
        else:
            _, _, sums, heads = heapq.heappop(heap)
            if next_is_single():
                sums, heads = _placed(sums, heads, follow, tail, int(falling[at]), int(weight[at]))
                at += 1
            elif heap:
                _, _, b, hb = heapq.heappop(heap)
                sums, heads = _merged(sums, heads, b, hb, follow, tail)
            else:
                break
            push(sums, heads)
    out = []
    for i in heads.tolist():
        slot = []
        while i >= 0:
            slot.append(i)
            i = follow[i]
        out.append(slot)
    return out


def pack_group(sizes: list[int], capacity: int) -> list[list[int]]:
    """Subsets of items, none over capacity: the least number found to fit by differencing.

    The total allows some least k.  While a slot overflows k rises by what the fullest is over; between the last k that
    failed and the first that fits the least that fits is then sought by halving.
    """
    failed, k = 0, max(1, math.ceil(sum(sizes) / capacity))
    best, fits = None, math.inf
    while k > failed and k < fits:
        slots = differencing(sizes, k)
        most = max(sum(sizes[i] for i in s) for s in slots)
        if most <= capacity:
            best, fits = slots, k
        else:
            failed = k
        # So many more windows that the fullest would fit if all shrank alike; or the middle.
        k = max(k + 1, k * most // capacity) if best is None else (failed + fits) // 2 if failed else fits
    return [s for s in best if s]


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0, piece: int = 256, group: int = 8192, with_ids: bool = True
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if ``with_ids``.

    A document's ids end with ``end_id``.  It is cut into full windows of ``capacity``, its rest into
    pieces of at most ``piece`` ids; ``group`` pieces at a time are packed by differencing, within the task that
    read them: no shuffle, and a retried task gives the same rows.  Sequence ids are unique over all tasks.
    Defined results: a null text is empty and has the end id alone; null ids and repeated rows are packed like
    others; an empty table gives no rows; other columns are not read; memory is bounded by one slice of
    texts and one group of pieces.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), *[("ids", pa.binary())] * with_ids]
    )
    wide = len(schema.names)

    def run(batches):
        cache, tail = piece_cache(tokenizer_path, 4), np.array([end_id], "<u4").tobytes()
        sequence, wait, rows = TaskContext.get().partitionId() << _TASK_BIT, [], []

        def flush():
            batch = to_batch(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))
            rows.clear()
            return batch

        def settle():
            nonlocal sequence
            for slot in pack_group([len(x[2]) // 4 for x in wait], capacity):
                at = 0
                for i in slot:
                    doc, start, ids, whole = wait[i]
                    rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), whole, sequence, at, ids)[:wide])
                    at += len(ids) // 4
                sequence += 1
            wait.clear()

        for batch in batches:
            for part in text_slices(batch, 1, rows=1024):
                for doc, ids in zip(part.column(0).to_pylist(), cache.totals(part.column(1)), strict=True):
                    ids += tail
                    whole = len(ids) // 4
                    full = whole - whole % capacity
                    for at in range(0, full, capacity):
                        own = ids[4 * at : 4 * (at + capacity)]
                        rows.append((doc, at, capacity, zlib.crc32(own), whole, sequence, 0, own)[:wide])
                        sequence += 1
                    for at in range(full, whole, piece):
                        wait.append((doc, at, ids[4 * at : 4 * min(at + piece, whole)], whole))
                    if len(wait) >= group:
                        settle()
                    if len(rows) >= 2000:
                        yield flush()
        if wait:
            settle()
        if rows:
            yield flush()

    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return columns_of(docs, id_col, text_col).select(F.col(id_col).cast("long"), text_col).mapInArrow(run, fields)
