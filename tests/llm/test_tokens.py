import heapq
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kinspark.llm import packing, tokencount, tokenrecords
from kinspark.llm.common import text_slices
from kinspark.llm.pretokens import PieceCache, piece_of, pieces_of

from .conftest import ODD_TEXTS


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_librarys_ids(tokenizer, tokenizer_path):
    small = PieceCache(tokenizer_path, 4, limit=3)
    for text in ODD_TEXTS + [" a", "a ", "a \n b", "a\n b", "\ta", " <|endoftext|>"]:
        assert "".join(map(piece_of, pieces_of(text or ""))) == (text or "")
        for cache in (PieceCache(tokenizer_path, 4), small):
            assert np.frombuffer(b"".join(cache.values([text])[0]), "<u4").tolist() == ids_of(tokenizer, text)
    assert sum(PieceCache(tokenizer_path).values(["The cat"])[0]) == 2


def test_a_full_cache_starts_anew_when_texts_change(tokenizer_path):
    cache = PieceCache(tokenizer_path, limit=50)
    first, second = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    want = [sum(v) for v in PieceCache(tokenizer_path).values([first, second])]
    for text, n in ((first, want[0]), (second, want[1])):
        for _ in range(4):
            assert sum(cache.values([text])[0]) == n
            cache._watch(0, 0, window=1)
    assert "v5" in cache.known and "w5" not in cache.known and len(cache.known) <= 120


def test_other_tokenizers_are_not_cut(tokenizer_path):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    cache = PieceCache(path, 4)
    assert not cache.exact_cuts
    want = Tokenizer.from_file(path).encode("The  Cat sat", add_special_tokens=False).ids
    assert np.frombuffer(b"".join(cache.values(["The  Cat sat"])[0]), "<u4").tolist() == want


def test_counts(odd, empty, tokenizer, tokenizer_path):
    got = Counter(tuple(r) for r in tokencount.count_tokens(odd, tokenizer_path).collect())
    n = {t: len(ids_of(tokenizer, t)) for t in [r.text for r in odd.collect()]}
    assert got == Counter((r.doc_id, len((r.text or "").encode()), n[r.text], n[r.text] > 1024) for r in odd.collect())
    assert tokencount.count_tokens(empty, tokenizer_path).count() == 0


def expected(odd, tokenizer):
    rows = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    return [(i, np.array(ids_of(tokenizer, t) + [0], "<u4")) for i, t in rows]


def test_records_round_trip(odd, empty, tokenizer, tokenizer_path):
    shards = tokenrecords.write_token_records(odd, tokenizer_path, shard_bytes=2000)
    assert shards.count() > 1
    got = tokenrecords.read_token_records(shards).orderBy("start").collect()
    want = expected(odd, tokenizer)
    assert [r.doc_id for r in got] == [i for i, _ in want]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), zlib.crc32(x)) for i, x in want)
    assert tokenrecords.read_token_records(tokenrecords.write_token_records(empty, tokenizer_path)).count() == 0


def test_slices_are_bounded_by_bytes():
    texts = ["a" * n for n in (3, 0, 9, 50, 1, 1, 1, 1, 8)] + [None, "é" * 5]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["i", "t"])
    for at in (0, 4):
        parts = [p.column(1).to_pylist() for p in text_slices(batch.slice(at), 1, rows=3, most_bytes=10)]
        assert [x for p in parts for x in p] == texts[at:]
        assert all(len(p) <= 3 and (len(p) == 1 or sum(len((x or "").encode()) for x in p) <= 10) for p in parts)
    assert list(text_slices(batch.slice(0, 0), 1)) == []


def test_records_of_one_id_are_spread(spark, tokenizer, tokenizer_path):
    rows = [(None, None)] * 2000 + [(7, "one text")] * 2000 + [(i, f"text {i}") for i in range(500)]
    docs = spark.createDataFrame([rows[i * 2003 % len(rows)] for i in range(len(rows))], "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = tokenrecords.write_token_records(docs, tokenizer_path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r.n_docs for r in shards.collect()) < 2000
    got = tokenrecords.read_token_records(shards).orderBy("start").collect()
    want = expected(docs, tokenizer)
    assert [r.doc_id for r in got] == [i for i, _ in want]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), zlib.crc32(x)) for i, x in want)


def test_records_are_read_in_any_order_and_checked(odd, tokenizer_path, tmp_path):
    shard = tokenrecords.write_token_records(odd, tokenizer_path, f"file://{tmp_path}/r").orderBy("n_docs", ascending=False).first()
    straight = list(tokenrecords.read_records(shard.path))
    n = len(straight)
    mixed = list(tokenrecords.read_records(shard.path, range(n - 1, -1, -1)))
    assert [(a, b.tolist()) for a, b in mixed[::-1]] == [(a, b.tolist()) for a, b in straight]
    record = tokenrecords.pack_record(7, b"\1\0\2\0", 2)
    assert tokenrecords.unpack_record(record)[1].tolist() == [1, 2]
    for i in range(len(record)):
        with pytest.raises(ValueError):
            tokenrecords.unpack_record(record[:i] + bytes([record[i] ^ 1]) + record[i + 1 :])


def test_packing_is_whole_and_tight(odd, empty, spark, sf_dir, tokenizer, tokenizer_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in (odd.where("doc_id is not null").dropDuplicates(["doc_id"]), docs):
        got = packing.pack_documents(df, tokenizer_path).collect()
        want = {i: x for i, x in expected(df.select("doc_id", "text"), tokenizer)}
        seen = Counter()
        for r in got:
            own = want[r.doc_id][r.start : r.start + r.length]
            assert r.ids == own.tobytes() and r.ids_crc32 == zlib.crc32(own) and r.doc_tokens == len(want[r.doc_id])
            seen.update((r.doc_id, j) for j in range(r.start, r.start + r.length))
        assert len(seen) == sum(map(len, want.values())) and set(seen.values()) == {1}
        windows = {}
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == windows.get(r.sequence_id, 0)
            windows[r.sequence_id] = r.offset + r.length
        assert max(windows.values()) <= 1024
    padding = sum(1024 - n for n in windows.values() if n & (n - 1))
    assert padding < 0.01 * sum(windows.values())
    assert packing.pack_documents(empty, tokenizer_path).count() == 0
    assert packing.pack_documents(odd, tokenizer_path).where("doc_id is null").count() == 2


def plain_differencing(sizes, k):
    """Karmarkar-Karp from single items, as the book has it: (rising sums of the slots, merges)."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    heap = [(-sizes[i], place, [(0, [])] * (k - 1) + [(sizes[i], [i])]) for place, i in enumerate(order)]
    heapq.heapify(heap)
    merges = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = sorted((x + y, p + q) for (x, p), (y, q) in zip(a, b[::-1], strict=True))
        both = [(x - both[0][0], p) for x, p in both]
        merges += 1
        heapq.heappush(heap, (-both[-1][0], -merges, both))
    return sorted(sum(sizes[i] for i in p) for _, p in heap[0][2]), merges


def test_differencing_is_karmarkar_karp_from_single_items():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, k, most = int(rng.integers(1, 60)), int(rng.integers(2, 25)), int(rng.choice([3, 20, 256, 1000]))
        sizes = rng.integers(1, most + 1, n).tolist()
        sums = [sum(sizes[i] for i in slot) for slot in packing.differencing(sizes, k)]
        want, merges = plain_differencing(sizes, k)
        assert sorted(sums) == want and merges == n - 1


def test_differencing_balances():
    rng = np.random.default_rng(0)
    for k in (1, 2, 7, 40):
        sizes = rng.integers(1, 257, 400).tolist()
        slots = packing.differencing(sizes, k)
        assert sorted(i for s in slots for i in s) == list(range(400))
        sums = [sum(sizes[i] for i in s) for s in slots]
        assert max(sums) - min(sums) <= 8
    assert all(sum([600, 600, 600][i] for i in s) <= 1024 for s in packing.pack_group([600, 600, 600], 1024))
    assert packing.differencing([5], 3)[-1] == [0] or [0] in packing.differencing([5], 3)


def first_fit(sizes, capacity):
    """Windows that first-fit decreasing takes."""
    free = []
    for s in sorted(sizes, reverse=True):
        at = next((i for i, f in enumerate(free) if f >= s), None)
        if at is None:
            free.append(capacity - s)
        else:
            free[at] -= s
    return len(free)


@pytest.mark.parametrize(("low", "high"), [(200, 200), (190, 215), (205, 256), (100, 100), (1, 256), (256, 256), (1, 1), (170, 171), (341, 342)])
def test_window_counts_are_near_first_fit(low, high):
    sizes = np.random.default_rng(5).integers(low, high + 1, 2048).tolist()
    slots = packing.pack_group(sizes, 1024)
    assert sorted(i for s in slots for i in s) == list(range(2048)) and max(sum(sizes[i] for i in s) for s in slots) <= 1024
    assert len(slots) <= 1.05 * first_fit(sizes, 1024)
