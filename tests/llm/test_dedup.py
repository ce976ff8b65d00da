from __future__ import annotations

import itertools

import nasty
import numpy as np
import pytest

from cairn.llm import bag_minhash as B


def brute_force(rows, p):
    bags = {}
    for i, t in rows:
        if i is not None and t and len(b := B.bag(t, p.shingle)) and len(b[0]):
            bags.setdefault(i, []).append(b)
    parent = {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(bags), 2):
        if any(B.jaccard(x, y) >= p.threshold for x in bags[a] for y in bags[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {(i, find(i)) for i in bags if find(i) != i}


def test_signatures_are_unbiased_and_consistent():
    rng = np.random.default_rng(0)
    off = []
    for _ in range(30):
        s = rng.integers(0, 2**48, 300).astype(np.uint64)
        a, b = np.minimum(rng.geometric(0.4, 300) ** 2, 90), rng.geometric(0.4, 300)
        h = B.signatures(np.repeat([0, 1], 300), np.concatenate([s, s]), np.concatenate([a, b]), 2, 160, 1)
        assert np.array_equal(B.signatures(np.zeros(300, int), s, a, 1, 160, 1)[0], h[0])
        off.append((h[0] == h[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.03


def test_few_and_heavy_shingles_fill_every_position():
    h = B.signatures(np.zeros(1, int), np.array([5], np.uint64), np.array([1000]), 1, 160, 1)
    assert np.isfinite(h).all()
    assert np.isfinite(B.signatures(np.zeros(1, int), np.array([5], np.uint64), np.array([1]), 1, 160, 1)).all()


def test_shingles_count_multisets():
    s, c = B.bag("a b c a b c a b c", 3)
    assert sorted(c.tolist()) == [2, 2, 3]
    assert len(B.bag("A b", 3)[0]) == 1 and B.jaccard(B.bag("A b", 3), B.bag("a  b", 3)) == 1
    assert len(B.bag(" \n", 3)[0]) == 0


def test_groups_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    p = B.Params()
    got = {(r.doc_id, r.keep_id) for r in B.near_duplicates(docs, p).collect()}
    want = brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], p)
    assert want and len(got & want) >= 0.9 * len(want) and got <= want


def test_pairs_that_the_hub_misses_are_compared(spark):
    """Bucket mates unlike the least of them, but like each other."""
    p = B.Params(bands=200, rows=1, threshold=0.6)
    base = nasty.prose(50, 60).split()
    rows = [(1, " ".join(base[:30] + nasty.prose(51, 40).split())), (2, " ".join(base)), (3, " ".join([*base[:58], "other", "end"])), (4, nasty.prose(99, 50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.keep_id) for r in B.near_duplicates(docs, p).collect()} == brute_force(rows, p) == {(3, 2)}


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5)], "a long, b long")
    assert {(r.node, r.component) for r in B.components(e).collect()} == {(2, 1), (3, 1), (4, 1), (8, 7), (9, 7)}


def test_odd_rows(spark):
    docs = nasty.documents(spark)
    got = {(r.doc_id, r.keep_id) for r in B.near_duplicates(docs).collect()}
    assert got == {(2, 1), (3, 1)}
    kept = B.remove(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x)) == [1, 4, 5, 6, 7, 8, 9, 10, None, None]


def test_empty_table(spark):
    assert B.near_duplicates(nasty.empty(spark)).collect() == []
    assert B.remove(nasty.empty(spark)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 40])
def test_many_copies_are_one_group(spark, n):
    docs = spark.createDataFrame([(i, nasty.prose(3, 80)) for i in range(n)], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id) for r in B.near_duplicates(docs).collect()} == {(i, 0) for i in range(1, n)}


def test_more_texts_than_16_bits_number(spark):
    """In one batch of small texts each keeps its own shingles."""
    from cairn.llm.common import pieces

    texts = [f"text {i:05d}" for i in range(70_000)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.arange(70_001) * 10
    seen = [x for a, b in pieces(offsets) for x in B.weighted_shingles(raw, offsets[a : b + 1], 3)[1].tolist()]
    assert len(seen) == 70_000 == len(set(seen))
    with pytest.raises(ValueError, match="70000 values"):
        B.weighted_shingles(raw, offsets, 3)


def test_all_pairs_that_share_a_band_and_overlap_are_joined(spark):
    """Exact, given the bands: components of the pairs that share one."""
    p = B.Params(bands=6, rows=2)
    rows = [(k * 10 + j, " ".join([*nasty.prose(400 + k, 50).split()[: 50 - 3 * j], *nasty.prose(500 + 7 * k + j, 4 * j).split()])) for k in range(8) for j in range(7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {r.doc_id: set(r.s.bands) for r in docs.select("doc_id", B.sketched(p)("text").alias("s")).collect()}
    bags = {i: B.bag(t, p.shingle) for i, t in rows}
    edges = [(a, b) for a, b in itertools.combinations(sorted(bags), 2) if keys[a] & keys[b] and B.jaccard(bags[a], bags[b]) >= p.threshold]
    group = {i: i for i in bags}
    for _ in bags:
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    assert edges and {(r.doc_id, r.keep_id) for r in B.near_duplicates(docs, p).collect()} == {(i, g) for i, g in group.items() if g != i}


def test_own_names_as_further_columns_and_other_ids(spark):
    docs = spark.createDataFrame([(f"d{i}", nasty.prose(i // 2, 60), 1, 2, 3) for i in range(6)], "doc_id string, text string, _gone int, _n int, _nth int")
    assert {(r.doc_id, r.keep_id) for r in B.near_duplicates(docs).collect()} == {("d1", "d0"), ("d3", "d2"), ("d5", "d4")}
    kept = B.remove(docs.unionByName(docs.limit(1)))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == ["d0", "d2", "d4"]
