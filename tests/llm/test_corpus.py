"""Repeated strings, resampling and phrases against brute force."""

import hashlib
import math
import os
import pickle
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinspark.llm import hashcount, phrases, repeats, resample

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = (1 << 63) - 1


# --- repeated strings


def without_repeats(docs, width=100):
    """Rows of (doc_id, n_bytes, n_removed, n_spans, kept_sha256) of (doc_id, hash of the text, text)."""
    seen, out = set(), {}
    for i, h, t in sorted({(LAST if i is None else i, h, t or "") for i, h, t in docs}, key=lambda r: r[:2]):
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - width + 1):
            if (w := raw[p : p + width]) in seen:
                gone[p : p + width] = True
            seen.add(w)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[i, h] = (len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, x in zip(raw, gone, strict=True) if not x)).hexdigest())
    return Counter((i, *out[LAST if i is None else i, h]) for i, h, _ in docs)


def repeating(seed=1):
    rng = np.random.default_rng(seed)
    para = "".join(rng.choice(list("abcdé "), 400))
    own = lambda n: "".join(rng.choice(list("xyz"), n))
    texts = [None, "", "short", para, para, para[:150] + "Z" + para[151:], "x" * 5000, "xy" * 300, "q" + para[10:320], para[:99], para[:100], "ab\0" * 60, para + para, "The cat sat. " * 3000]
    rows = [*enumerate(texts), (None, para), (3, para), (3, "y" + para), (None, para[5:]), (None, None)]
    return rows + [(1000 + i, own(i % 60) + para + own(60)) for i in range(200)]


@pytest.mark.parametrize("options", [{}, {"hot": 5, "most_kept": 7, "shard_bytes": 2000, "bucket_bytes": 20_000}, {"hot": 50, "most_hot": 3, "most_broadcast": 0}])
def test_repeats_are_brute_force(spark, options):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in repeating()], "doc_id long, text string, start long, body string").repartition(3)
    got = repeats.without_repeats(docs, **options)
    want = without_repeats([tuple(r) for r in docs.select("doc_id", F.xxhash64("text"), "text").collect()])
    assert Counter(tuple(r) for r in got.collect()) == want
    assert repeats.without_repeats(docs.limit(0), **options).count() == 0


def test_least_hashes_are_dealt_evenly():
    text = np.random.default_rng(5).integers(97, 123, 300_000).astype(np.uint8).tobytes().decode()
    _, h = repeats.Anchors(pa.array([text]), 100).chosen()
    assert len(h) > 5000 and np.bincount(h >> np.uint64(59), minlength=32).max() < 2 * len(h) / 32  # of 32 chunks


def test_repeats_of_the_whole_table_are_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = repeats.without_repeats(docs, with_kept=True).collect()
    assert Counter(tuple(r)[:5] for r in got) == without_repeats([tuple(r) for r in docs.select("doc_id", F.xxhash64("text"), "text").collect()])
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in got)
    with pytest.raises(ValueError):
        repeats.without_repeats(docs, width=90)


def test_a_transform_gives_its_strings_back_and_merging_sorts_by_symbols():
    rng = np.random.default_rng(2)
    strings = list({bytes(rng.choice([97, 98], rng.integers(100, 140)).astype(np.uint8)) for _ in range(30)} | {b"a" * 150, b"ab" * 60, b"ba" * 70})
    code = np.zeros(256, np.uint8)
    code[[97, 98]] = 1, 2
    shards = [repeats.Shard(strings[a : a + 7], code) for a in range(0, len(strings), 7)]
    for s, part in zip(shards, (strings[a : a + 7] for a in range(0, len(strings), 7)), strict=True):
        front = s.last_to_first()
        for row in np.flatnonzero(s.bwt == 0):  # the row where a string begins: walk from its end
            at, out = front[row], []
            while s.bwt[at]:
                out.append(96 + int(s.bwt[at]))
                at = front[at]
            assert bytes(out[::-1]) == part[s.string[row]] and s.offset[row] == 0
    rotation, base = [], 0
    for k, s in enumerate(shards):
        for t, o in zip(s.string, s.offset, strict=True):
            whole = code[np.frombuffer(strings[7 * k + t], np.uint8)].tobytes() + b"\0"
            rotation.append(((whole[o:] + whole[:o]) * 2)[:100])
    order, common = repeats.merged(shards, 100)
    got = [rotation[i] for i in order]
    assert sorted(order.tolist()) == list(range(len(rotation))) and got == sorted(rotation)
    for a, b, n in zip(got, got[1:], common[1:].tolist(), strict=False):
        same = next((i for i in range(100) if a[i] != b[i]), 100)
        assert n == same // 20 * 20


def test_sums_of_hashes_by_chunks(spark):
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    docs = spark.createDataFrame([(" ".join(map(str, rng.integers(0, 500, 40))),) for _ in range(100)], "text string").repartition(4)
    hashes = lambda part: [h[[int(x) for t in part.column(0).to_pylist() for x in t.split()]]]
    count = Counter(int(h[int(x)]) >> (64 - 35) for r in docs.collect() for x in r.text.split())
    got = {r.slot: r.n for r in hashcount.frequent_slots(docs, hashes, 3, 9).collect()}
    assert got == {s: n for s, n in count.items() if n >= 9}
    bits = hashcount.Bitmap(20, 3).with_slots(spark.createDataFrame([(s,) for s in got], "slot long"))
    assert bits.has(h[[int(x) >> 29 in got for x in h]]).all() and bits.has(rng.integers(0, 1 << 63, 1000, dtype=np.uint64)).mean() < 0.05


def test_a_copy_in_a_task_is_one_known_row(spark):
    # Copies that a task meets again sent a row for each of their segments, although neighbours touch.
    rng = np.random.default_rng(5)
    text = "".join(chr(97 + int(x)) for x in rng.integers(0, 26, 3000))
    texts = repeats._keyed(spark.createDataFrame([(i, text) for i in range(20)], "doc_id long, text string").coalesce(1), "doc_id", "text")
    every = hashcount.Bitmap(20, 3)
    every.map[:] = -1
    got = repeats._segments(texts, every, np.zeros(0, np.uint64), 7, 100, 60_000).collect()
    known = [r for r in got if r.body is None]
    assert sorted((r.id, r.start, r.length) for r in known) == [(i, 0, 3000) for i in range(1, 20)]
    assert {r.id for r in got if r.body is not None} == {0}
    assert repeats.joined([(1, 2, 5, 9), (1, 2, 0, 5), (1, 3, 9, 10), (1, 2, 10, 11)]) == [(1, 2, 0, 9), (1, 2, 10, 11), (1, 3, 9, 10)]


def test_stored_tables_leave_no_shuffle_files(spark):
    from kinspark.llm import common

    key = common._CLEANUP
    before = spark.conf.get(key, None)
    out = common.stored(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "kept")
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    stale = tracker.shuffleStatuses().size()
    common.stored(spark.range(1000).repartition(3, "id"), "kept")
    assert tracker.shuffleStatuses().size() <= stale and out.count() == 7 and spark.conf.get(key, None) == before


# --- resampling


def resampled(docs, bench, percent=10, longest=1, n=10_000):
    def buckets(t):
        w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % n for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(b for _, x in docs for b in buckets(x)), Counter(b for x in bench for b in buckets(x))
    gain = [math.floor(1000 * math.log((t[b] + 1) * float(s.total() + n) / ((s[b] + 1) * float(t.total() + n)))) for b in range(n)]
    rows, able = [], []
    for i, x in docs:
        b = buckets(x)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[k] for k in b)
        rows.append([i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(b) >= sum(max(0, 20 - k) for k in range(longest)):
            able.append(rows[-1])
    able.sort(key=lambda r: (-r[3], LAST if r[0] is None else r[0]))
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = k
    return Counter(map(tuple, rows))


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_is_brute_force(spark, odd, longest):
    texts = [f"the {'quick brown fox ' * (i % 9)}jumps over Lazy dogs number {i} and runs away from all of them again" for i in range(60)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([*enumerate(texts, 500), *[(None, texts[8])] * 3, *[(7, texts[17])] * 40], "doc_id long, text string"))
    docs = docs.withColumn("score", F.lit(1)).withColumn("buckets", F.lit("x"))
    bench = ["a quick brown fox", None, "", "lazy dogs RUN away"]
    target = spark.createDataFrame([(t, "x") for t in bench], "text string, rank string")
    gains = resample.bucket_gains(docs, target, longest=longest)
    got = resample.resample(docs, gains, longest=longest, percent=30)
    want = resampled([(r.doc_id, r.text) for r in docs.collect()], bench, 30, longest)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and Counter(tuple(r) for r in got.collect()) == want
    none = docs.limit(0)
    assert resample.resample(none, resample.bucket_gains(none, target), longest=longest).count() == 0
    assert set(resample.bucket_gains(none, none)) == {0}
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().toString())


def test_ranks_of_equal_scores_are_dealt_by_ranges(spark):
    docs = spark.range(0, 20_000, 1, 8).selectExpr("if(id % 2 = 0, 7, id) as doc_id", "'one two three four five six seven eight nine ten one two three four five six seven eight nine ten' as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = resample.resample(docs, [1] * 100, percent=100).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.rank for r in got) == list(range(1, 20_001))
    order = sorted(got, key=lambda r: r.rank)
    assert all((a.score, -a.doc_id) >= (b.score, -b.doc_id) for a, b in zip(order, order[1:], strict=False))


# --- phrases


def collocations(docs, longest=4, least=30, top=2000, covered=80):
    counts = defaultdict(Counter)
    for text, lang in docs:
        c = counts["und" if lang is None else lang]
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            for k in range(1, longest + 1):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        n, longer, rows = sum(v for p, v in c.items() if len(p) == 1), Counter(), []
        good = {p: v for p, v in c.items() if len(p) > 1 and v >= least}
        for p, v in good.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], v)
        for p, a in good.items():
            if 100 * longer[p] < covered * a:
                score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, x[2].decode(), -x[1], x[3], x[4], n, -x[0]) for i, x in enumerate(sorted(rows)[:top], 1)]
    return Counter(out)


PHRASES = [
    ("New York city Hall. new york\tCITY hall; new york", "en"), ("", "en"), (None, "en"), ("a a a a a a", None), ("a a a a", "und"), ("x\x0by z, x y z", "de"), ("été x b\x00c été x b\x00c", "fr"),
    ("new york", "de"), ("of the of the of the end", "en"), ("one. two one", "en"), ("word", None), ("long " * 30_000, "long"),
]


@pytest.mark.parametrize("options", [{}, {"block_phrases": 2, "shard_bytes": 200, "most_bits": 8}, {"most_broadcast": 0}])
def test_collocations_are_brute_force(spark, options):
    rows = [(t, g) for k, (t, g) in enumerate(PHRASES) for _ in range(5 + k)]
    docs = spark.createDataFrame([(t, g, 1, "p") for t, g in rows], "text string, lang string, n long, phrase string").repartition(3)
    for least, longest, top in ((10, 4, 2000), (7, 2, 2), (1, 3, 2000)):
        got = phrases.collocations(docs, least=least, longest=longest, top=top, **options)
        assert Counter(tuple(r) for r in got.collect()) == collocations(rows, longest, least, top)
    assert phrases.collocations(docs.limit(0), **options).count() == 0


@pytest.mark.parametrize("blocks", [1, 5, 40])
def test_collocations_shared_by_languages_count_once(spark, blocks):
    # Each phrase has another block in each language; stretches of a block hold whole longer runs.
    words = ["a", "b", "c", "d"]
    rows = [(" ".join(words[(i + j * (1 + i % 3)) % 4] for j in range(9)), lang) for i in range(60) for lang in ("en", "de", "fr", None)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = phrases.collocations(docs, least=5, block_words=max(1, 9 * len(rows) // blocks))
    assert Counter(tuple(r) for r in got.collect()) == collocations(rows, 4, 5, 2000)


def test_bitmaps_are_sent_small_and_their_files_go(spark, monkeypatch):
    # Before, each of seven steps left a file of the whole bitmap on the driver and on every executor.
    bits = hashcount.Bitmap(28, 3, phrases._LOW_BITS)
    bits.map[::50_000] = 7
    sent = pickle.dumps(bits)
    assert len(sent) < 1 << 20 and (pickle.loads(sent).map == bits.map).all()
    made, broadcast = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: made.append(broadcast(value)) or made[-1])
    docs = spark.createDataFrame([(t, g) for t, g in PHRASES for _ in range(5)], "text string, lang string")
    assert phrases.collocations(docs, least=5).count()
    # Two sketches, stretches and candidates; a larger command of a task would be one more.
    assert len([b for b in made if not os.path.exists(b._path)]) == len(made) == 4


def test_one_step_of_python_fills_the_bitmap(spark, monkeypatch):
    # Before, words' slots were made by one and placed by another: four workers on two cores, all of which the later steps filled.
    plans, fill = [], hashcount.Bitmap.with_slots
    monkeypatch.setattr(hashcount.Bitmap, "with_slots", lambda self, rows, *more: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or fill(self, rows, *more))
    docs = spark.createDataFrame([(t, g) for t, g in PHRASES for _ in range(5)], "text string, lang string")
    assert phrases.collocations(docs, least=5).count()
    assert len(plans) == 3 and not any("InArrow" in p for p in plans)


def test_stretches_travel_packed_by_block_and_language(spark):
    # A row for each distinct stretch grew with the square of the table; now a task sends one for a block and language.
    rows = [(f"w{i % 90} w{i % 70} w{i % 50} w{i}", lang) for i in range(400) for lang in ("en", "de")]
    texts = phrases._texts(spark.createDataFrame(rows, "text string, lang string").coalesce(1), "text", "lang")
    every = hashcount.Bitmap(20, 3, phrases._LOW_BITS)
    every.map[:] = -1
    got = phrases._stretches(texts, every, 2, 3).toArrow()
    assert len(got) == 6 and set(got.column("lang").to_pylist()) == {"en", "de"}
    met = Counter()
    for k in range(len(got)):
        row = got.slice(k, 1)
        n = np.frombuffer(row.column("times")[0].as_py(), "<i8").tolist()
        more = phrases._lines(row, "more")[0].split("\n") if n else []
        for line, times in [*((x, 1) for x in phrases._lines(row, "once")[0].split("\n") if x), *zip(more, n, strict=True)]:
            met.update({(row.column("lang")[0].as_py(), w): times for w in set(line.split())})
    assert all(met[lang, w] >= 1 for text, lang in rows for w in text.split())
    assert met["en", "w0"] >= sum("w0" in text.split() for text, lang in rows if lang == "en")


def test_equal_stretches_of_all_tasks_become_one(spark):
    # Before, each task sent a row for each block, so rows grew with the square of the table and equal stretches stayed apart.
    rows = [(f"w{i % 9} w{i % 7} w{i % 5}. w{i % 4}", lang) for i in range(900) for lang in ("en", "de")]
    every = hashcount.Bitmap(20, 3, phrases._LOW_BITS)
    every.map[:] = -1
    met = []
    for tasks, options in ((1, {}), (8, {}), (8, {"route_blocks": 5})):
        texts = phrases._texts(spark.createDataFrame(rows, "text string, lang string").repartition(tasks), "text", "lang")
        got = phrases._stretches(texts, every, 2, 12, **options).toArrow()
        keys = list(zip(got.column("block").to_pylist(), got.column("lang").to_pylist(), strict=True))
        assert len(set(keys)) == len(keys) == 24
        met.append(Counter())
        for k, key in enumerate(keys):
            row = got.slice(k, 1)
            once, more = ([x for x in phrases._lines(row, c)[0].split("\n") if x] for c in ("once", "more"))
            assert len({*once, *more}) == len(once) + len(more)
            met[-1].update({(*key, x): 1 for x in once} | {(*key, x): n for x, n in zip(more, np.frombuffer(row.column("times")[0].as_py(), "<i8").tolist(), strict=True)})
    assert met[0] == met[1] == met[2]


def test_sums_are_sent_by_bytes_too(monkeypatch):
    # Before, 200,000 rows were held whatever their length.
    sums = phrases._Summing(pa.schema([("stretch", pa.string()), ("n", pa.int64())]))
    monkeypatch.setattr(sums, "most_bytes", 100_000, raising=False)
    added = lambda i: sums.add(stretch=pa.array(["x" * 9_990 + str(i)]), n=pa.array([1]))
    assert not [b for _ in range(60) for b in added(7)]
    sent = [b for i in range(60) for b in added(i)]
    assert 4 <= len(sent) <= 8 and max(b.nbytes for b in sent) < 250_000
    rest = list(sums.send())
    assert sum(sum(b.column("n").to_pylist()) for b in [*sent, *rest]) == 120


def test_slots_are_packed_as_differences():
    n = np.array([0, 1, 7, 255, 256, 1 << 31, (1 << 32) - 1], np.uint64)
    assert hashcount.unpacked(hashcount.packed(n), len(n)).tolist() == n.tolist()
    assert len(hashcount.packed(np.full(100_000, 3))) < 1000


def test_collocation_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    big = 5 * 10**15
    words = spark.createDataFrame([("en", "a", big + 1), ("en", "b", big)], "lang string, phrase string, a long")
    both = spark.createDataFrame([("en", "a b", big - 1)], "lang string, phrase string, a long")
    monkeypatch.setattr(phrases, "phrase_counts", lambda *a, **k: (words, both))
    (r,) = phrases.collocations(words).collect()
    assert r.score == 2000000 * (big - 1) // (2 * big + 1) and (r.l, r.r, r.n) == (big + 1, big, 2 * big + 1)
