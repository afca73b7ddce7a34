"""Hubs in the component search; bound, work and recall of the nearest-neighbour search."""

import random
from math import comb

import duckdb
import numpy as np
from scorelab.llm import ann
from scorelab.llm.common import Scratch, components
from scorelab.llm.queries import op4_multi_index_hashing

SF = "/root/testdata/sf0.1"


def roots(edges):
    """Brute force: least node of each node's component."""
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in edges:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            up[hi] = lo
    return {x: find(x) for x in up}


def test_components_with_hubs_equal_union_find(spark):
    """Hubs beyond ``join_hot``'s bar (1,000 links): the least node, the greatest node and one in between."""
    rng = random.Random(5)
    edges = [(0, i) for i in range(10_000, 13_000)] + [(99_999, i) for i in range(20_000, 22_500)]
    edges += [(30_000, i) for i in range(29_000, 31_500)]
    edges += [(40_000 + i, 40_001 + i) for i in range(60)] + [(50_000, 50_000), (10_500, 20_100)]
    edges += [(rng.randrange(60_000, 60_400), rng.randrange(60_000, 60_400)) for _ in range(250)]
    rng.shuffle(edges)
    with Scratch(spark) as scratch:
        found = components(spark, spark.createDataFrame(edges + edges[:500], "a long, b long"), scratch).collect()
    want = roots(edges)
    assert len(found) == len(want) and {r.node: r.root for r in found} == want


def test_probes_are_one_bit_nearer_beyond_the_remainder():
    index = ann.SubstringTables(np.zeros((1, 48), bool), 12)
    for radius in (0, 2, 13, 19):
        near, left = divmod(radius, 4)
        sizes = [len(m) for m in index.probes(radius)]
        assert sizes == [sum(comb(12, t) for t in range(near + (i <= left))) for i in range(4)]


def test_recall_on_the_given_table(spark):
    """The registered query against brute force: recall of at least 0.9 and exact scores."""
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' WHERE embedding IS NOT NULL").fetchall()
    rows = [(i, v) for i, v in rows if all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got = {}
    for r in op4_multi_index_hashing(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    asked = [i for i in ids.tolist() if i % 20 == 0]
    assert sorted(got) == sorted(asked)
    hits = 0
    for q in asked:
        score = ann.inner_products(x[ids == q][0], x)
        exact = dict(zip(ids.tolist(), score.tolist(), strict=True))
        best = [int(ids[j]) for j in np.lexsort((ids, -score)) if ids[j] != q][:20]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(exact[i] == s for _, i, s in found)
        hits += len(set(best) & {i for _, i, _ in found})
    assert hits >= 0.9 * 20 * len(asked)
