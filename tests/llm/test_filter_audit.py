"""Filter interaction audit: popcounts and the whole report against brute force."""

import re
from itertools import permutations

import numpy as np
import pytest

from scorelab.llm import filter_audit as A

from .util import DOC_SCHEMA, empty, messy

LABELS = "doc_id long, quality int, toxic int, part string"


def failures(rows):
    """Per (id, text) row the set of filters it fails."""
    out = []
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u in rows) else set()
        out.append(fails)
    return out


def brute(docs, labels):
    rows = [(r.doc_id, r.text) for r in docs]
    fails = failures(rows)
    good = {r.doc_id for r in labels if r.quality == 1 and r.doc_id is not None}
    toxic = {r.doc_id for r in labels if r.toxic == 1 and r.doc_id is not None}
    out, removals = {}, {}
    for part in {r.source or "" for r in docs}:
        mine = [(r.doc_id, f) for r, f in zip(docs, fails) if (r.source or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                out[part, order, step] = [len(left), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == {x} for _, f in mine),
                                          sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                removals[part, x] = removals.get((part, x), 0) + len(gone)
    return {k: (*v, removals[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 64, 1000, 4097])
def test_positional_popcount(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    want = [int((words >> np.uint32(b) & np.uint32(1)).sum()) for b in range(32)]
    assert A.positional_popcount(words).tolist() == want


def test_steps_cover_all_orders():
    steps = A.filter_steps()
    assert len({(s["o"], s["step"]) for s in steps}) == 600


def test_report_against_brute_force(spark):
    prose = " ".join(f"w{i}" for i in range(230))
    extra = [(20, prose), (21, prose), (20, prose), (22, prose + " #"), (23, prose.upper()), (24, "W" + prose), (25, "a b " * 150), (None, prose), (26, None)]
    docs = messy(spark, extra)
    labels = spark.createDataFrame([(20, 1, 0, "x"), (20, 0, 1, "x"), (21, 1, None, "x"), (8, None, 1, "x"), (None, 1, 1, "x"), (99, 1, 1, "x"), (9, 1, 0, "x")], LABELS)
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
           for r in A.audit(spark, docs, labels).collect()}
    assert got == brute(docs.collect(), labels.collect())


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert A.audit(spark, empty(spark), none).count() == 0
    assert A.audit(spark, spark.createDataFrame([(1, None, None, None, None, None, None, None, None, None, None)], DOC_SCHEMA), none).count() == 600


def test_counts_leave_a_task_in_slices(spark, monkeypatch):
    monkeypatch.setattr(A, "MAX_KEYS", 3)
    rows = spark.range(4000).selectExpr("concat('p', id % 40) part", "cast(id % 4 as int) class", "id * 7919 % 4294967296 word")
    got = {r.part: r for r in A.subset_survivors(rows).collect()}
    assert len(got) == 40 and sum(r.survivors[0] for r in got.values()) == rows.filter("word % 2 = 1").count()


def test_hot_text_is_joined_by_broadcast(spark, monkeypatch):
    """A text on very many rows gives the same flags through either half of the join."""
    docs = spark.range(3000).selectExpr("id doc_id", "if(id % 3 = 0, 'same', concat('t', id div 2)) text", "'s' source", "1 again", "2 least")
    none = spark.createDataFrame([], LABELS)
    got = A.audit(spark, docs, none).filter("filter_order = 'EABCD' AND step = 1").first()
    texts = [(i, "same" if i % 3 == 0 else f"t{i // 2}") for i in range(3000)]
    first = {}
    for i, t in texts:
        first.setdefault(t, i)
    assert got.removed == sum(first[t] != i for i, t in texts)
