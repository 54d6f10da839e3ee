import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kinspark.llm import simhash
from kinspark.llm.components import connected_components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def check(df, **options):
    rows = [(r.doc_id, brute_print(r.text)) for r in df.collect()]
    root = brute_groups([p for _, p in rows])
    least = {}
    for (i, _), g in zip(rows, root, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = Counter((i, f"{p:016x}", least.get(g)) for (i, p), g in zip(rows, root, strict=True))
    assert Counter(tuple(r) for r in simhash.near_duplicates(df, **options).collect()) == want


def test_golay_code():
    index = simhash.codeword_index()
    assert np.bincount(index[: 1 << 22], minlength=4096).min() > 0
    v = np.array([0, 1, 0b111, 0b1110000], np.uint32)
    assert index[v].tolist() == [0, 0, 0, 0]  # all within three bits of the zero word


def test_keys_meet_for_every_three_bits():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 5000, dtype=np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, 5000, dtype=np.uint64)
    left = set(zip(*(x.tolist() for x in simhash.join_keys(a, 0)), strict=True))
    hit = {p for p, k in zip(*(x.tolist() for x in simhash.join_keys(b, 1)), strict=True) if (p, k) in left}
    assert len(hit) == 5000


@pytest.mark.parametrize("hot_share", [10_000, 2, 1])
def test_odd_rows_are_brute_force(odd, empty, hot_share):
    check(odd, hot_share=hot_share)  # all by broadcast, some of both, all by a shuffle
    assert simhash.near_duplicates(empty, hot_share=hot_share).count() == 0


def first_rows(rows):
    """(id, text) of the first row of each component, by brute force."""
    root = brute_groups([brute_print(t) for _, t in rows])
    hashed = {t: 0 if t is None else xxhash.xxh64(t.encode(), seed=42).intdigest() for _, t in rows}
    signed = {t: h - (1 << 64) if h >> 63 else h for t, h in hashed.items()}
    return Counter(min(((i is None, i or 0, signed[t]), i, t) for (i, t), g in zip(rows, root, strict=True) if g == mine)[1:] for mine in set(root))


def test_table_is_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(docs)
    kept = simhash.keep_one(docs)
    groups = simhash.near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.component_id for r in groups.collect()}


@pytest.mark.parametrize("most", [0, 1000])
def test_keep_one_of_odd_rows(odd, empty, most):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    kept = simhash.keep_one(odd, most_broadcast=most)
    assert kept.columns == odd.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == first_rows(rows)
    assert simhash.keep_one(empty, most_broadcast=most).count() == 0


A, B = "An own text that nothing else here is like at all.", "The other text, which two documents have in common today."


@pytest.mark.parametrize("order", list(permutations([(1, B), (5, B), (5, A)])))
def test_an_id_of_two_texts_loses_neither(spark, order):
    docs = spark.createDataFrame(list(order), "doc_id long, text string").coalesce(1)
    assert sorted(tuple(r) for r in simhash.keep_one(docs).collect()) == [(1, B), (5, A)]


def test_equal_rows_leave_the_same_one_in_any_order(spark):
    rows = [(7, A, f"s{i}", {"k": i}) for i in range(5)] + [(None, A, "x", None), (None, B, "y", None), (None, B, "z", None)]
    kept = []
    for some in (rows, rows[::-1]):
        got = simhash.keep_one(spark.createDataFrame(some, "doc_id long, text string, source string, m map<string, int>").repartition(3)).collect()
        kept.append(sorted((str(r.doc_id), r.text, r.source, str(r.m)) for r in got))
    assert kept[0] == kept[1] and [r[:2] for r in kept[0]] == [("7", A), ("None", B)]


def flipped(rng, centre, n, most, least=0):
    return {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(least, most + 1), replace=False)) for _ in range(n)}


def signed_prints(spark, prints):
    return spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")


@pytest.mark.parametrize("max_bits", [1, 2, 3])
def test_chains_connect_what_links_connect(spark, max_bits):
    rng = np.random.default_rng(5)
    prints = sorted(flipped(rng, 0x123456789ABCDEF0, 400, 3) | flipped(rng, 0xF00D << 40, 200, 9) | flipped(rng, 0, 100, 64) | {(1 << 64) - 1, 1 << 63})
    df = signed_prints(spark, prints)
    groups = []
    for edges in (simhash.chains(df, max_bits, dense=4), simhash.links(df, max_bits)):
        groups.append({(r.node, r.component) for r in connected_components(edges, "a", "b").collect()})
    assert groups[0] == groups[1] and len(groups[0]) > 100


def test_a_dense_family_has_few_edges(spark):
    rng = np.random.default_rng(6)
    prints = signed_prints(spark, sorted(flipped(rng, 0x0F1E2D3C4B5A6978, 18_000, 3, 3)))
    n = prints.count()
    edges = simhash.chains(prints)
    assert n > 14_000 and edges.count() < 100 * n
    assert connected_components(edges, "a", "b").select("component").distinct().count() == 1


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.node: r.component for r in connected_components(chain.unionByName(spark.createDataFrame([(900, 901), (5, 5)], "a long, b long")), "a", "b").collect()}
    assert got == {i: 0 for i in range(301)} | {900: 900, 901: 900}
