import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from scorelab.llm.common import Scratch, components
from scorelab.llm.near_dedup import (band_keys, hub_units, keep_one, least_matches, near_duplicates, open_units, shared_buckets,
                                     shingles, signature, verified_links)

from .util import empty, messy, near_classes, order


def family(rng, n, words=60, vocabulary=400, edits=6):
    """Near copies of one text, some of them far from others."""
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = []
    for size in (40, 12, 5, 3, 2, 2):
        out += family(rng, size)
    out += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) for _ in range(30)]
    out += [out[0]] * 25 + ["short one"] * 3
    rng.shuffle(out)
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("k,unit_weight", [(4, 1_000_000), (5, 1_000_000), (4, 2_000), (4, 600)])
def test_equals_brute_force(spark, texts, k, unit_weight):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = near_duplicates(spark, docs, k=k, unit_weight=unit_weight).collect()
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in got) == order(near_classes(texts, k))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def _reps(spark, texts, k=4):
    rows = []
    for i, t in enumerate(texts):
        s = shingles(t.encode(), k)
        rows.append((i, i, i, len(s), [int(x) for x in band_keys(signature(s))]))
    return spark.createDataFrame(rows, "rid long, id long, _h long, n long, bands array<long>")


def test_boilerplate_shared_by_all_texts_costs_rows_in_proportion(spark):
    """Texts that share 40 % of their shingles share buckets, yet only pairs inside a bucket meet."""
    rng = random.Random(11)
    common = " ".join(f"c{rng.randrange(10**6)}" for _ in range(60))
    counts = {}
    for n in (150, 600):
        texts = [common + " " + " ".join(f"o{rng.randrange(10**6)}" for _ in range(30)) for _ in range(n)]
        with Scratch(spark) as scratch:
            shared = shared_buckets(_reps(spark, texts), scratch)
            hubs = hub_units(shared, 1_000_000).count()
            found = components(spark, spark.createDataFrame([], "a long, b long"), scratch)
            more = open_units(shared, found, scratch, 1_000_000)
            counts[n] = hubs + (more.count() if more else 0)
        assert counts[n] <= 3 * 32 * n  # a class stands at most once in each of its buckets
    assert counts[600] < 6 * counts[150]


def test_a_hub_is_copied_to_chunks_and_meets_every_member_once(spark):
    rng = random.Random(12)
    with Scratch(spark) as scratch:
        shared = shared_buckets(_reps(spark, family(rng, 60, edits=3)), scratch)
        units = hub_units(shared, 1_000)
        spokes = units.filter("side = 1")
        assert spokes.select("unit").distinct().count() > 5
        pairs = spokes.select(F.split("cluster", "/")[0].alias("hub"), "rid")
        assert pairs.count() == pairs.distinct().count() == shared.filter("rid <> hub").select("hub", "rid").distinct().count()
        lone = spokes.join(units.filter("side = 0"), ["unit", "cluster"], "left_anti")
        assert lone.isEmpty()


def test_a_pair_is_left_to_the_first_band_it_shares():
    s = shingles(" ".join(f"w{i}" for i in range(80)).encode(), 4)
    t = shingles(" ".join(f"w{i}" for i in range(81)).encode(), 4)
    known, need = np.array([0, 1]), [least_matches(32 * b, 0.8, 1e-6) for b in range(1, 6)]
    same = (signature(s) == signature(t)).reshape(32, 5).all(axis=1)
    first = int(np.nonzero(same)[0][0])
    assert verified_links([s, t], known, 0, first, 80, 100, need) == [(0, 1)]
    assert verified_links([s, t], known, 0, first + 1, 80, 100, need) == []
    assert verified_links([s, t], known, 1, 0, 80, 100, need) == [(0, 1)]
    assert verified_links([s, t], np.array([7, 7]), 0, first, 80, 100, need) == []


def test_repeated_records_among_near_copies(spark):
    """Rows repeated whole (one id and text) are one text when texts are fetched."""
    rng = random.Random(13)
    own = family(rng, 6, edits=2)
    rows = [(0, own[0])] * 400 + list(enumerate(own))[1:]
    got = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), k=4)
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == order(near_classes(rows, 4))


def test_messy_rows(spark):
    docs = messy(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = near_duplicates(spark, docs, k=4).collect()
    want = near_classes(rows, 4)
    assert order((r.doc_id, r.n_shingles, r.component_id) for r in got) == order(want)
    assert near_duplicates(spark, empty(spark)).count() == 0


def test_keep_one_leaves_one_of_each_group(spark):
    docs = messy(spark)
    out = keep_one(spark, docs, k=4)
    assert out.columns == docs.columns
    ids = sorted(((r.doc_id, r.text and r.text[:8]) for r in out.collect()), key=repr)
    # 6 and 7, the null id's copy and the second row of 6 leave one; 9 repeats 8; 5 repeats 4 but for case
    assert [i for i, _ in ids if i in (6, 7)] == [6] and [i for i, _ in ids if i in (4, 5, 8, 9)] == [4, 8]
    assert sum(i is None for i, _ in ids) == 1  # the row without text
    assert keep_one(spark, empty(spark)).count() == 0


def test_bayesian_bound_falls_with_the_miss_probability():
    assert least_matches(32, 0.8, 1e-6) < least_matches(32, 0.8, 1e-2) <= 27
    assert least_matches(96, 0.8, 1e-6) / 96 > least_matches(32, 0.8, 1e-6) / 32


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200).astype(np.uint64)])
    assert abs((signature(a) == signature(b)).mean() - 800 / 1200) < 0.15


def test_shingles_of_short_and_long_texts():
    assert len(shingles(b"", 4)) == len(shingles(None, 4)) == 0
    assert len(shingles(b"a b", 4)) == 1 and len(shingles(b"a b c d e", 4)) == 2
    assert list(shingles(b"A\x0bB", 4)) == list(shingles(b"a b", 4))
