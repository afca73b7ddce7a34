import random
import re

from scorelab.llm.common import Scratch
from scorelab.llm.decontam import _item_terms, build_index, contamination, drop_contaminated, phrase_matches, proximity_matches, read_items
from pyspark.sql import functions as F

from .util import ascii_lower, empty, messy, order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(ascii_lower(t))


def brute(docs, items, window=13):
    out = []
    for i, t in docs:
        w = words(t)
        hit, names = set(), set()
        for name, text in items:
            v = words(text)
            size = min(window, len(v))
            wins = {tuple(v[s:s + size]) for s in range(len(v) - size + 1)} if v else set()
            for p in range(len(w) - size + 1) if size else ():
                if tuple(w[p:p + size]) in wins:
                    hit.update(range(p, p + size))
                    names.update([str(name)] if name is not None else [])
        out.append((i, len(w), len(hit), tuple(sorted(names)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def cases():
    rng = random.Random(9)
    say = lambda n, v=40: [f"w{min(rng.randrange(v), rng.randrange(v))}" for _ in range(n)]
    items = [(i, " ".join(say(rng.randrange(1, 40)))) for i in range(12)] + [(3, "Only, THIS!"), (20, None), (21, ""), (None, "null item words"), (0, "!?")]
    docs = []
    for i in range(120):
        w = say(rng.randrange(0, 200))
        for _ in range(rng.randrange(3)):
            src = words(rng.choice(items)[1])
            a = rng.randrange(len(src) + 1)
            at = rng.randrange(len(w) + 1)
            w[at:at] = src[a:] if rng.random() < 0.5 else src
        docs.append((i, (" " if i % 2 else ", ").join(w)))
    docs += [(500, "x ONLY -- this y null item words"), (500, "the same id again"), (None, items[2][1]), (501, items[1][1]), (501, items[1][1])]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = cases()
    got = contamination(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got.collect()]
    assert order(got) == order(brute(docs, items))


def test_messy_and_empty(spark):
    docs, items = messy(spark), spark.createDataFrame([(1, "ALPHA beta gamma", "n")], "item_id long, text string, tid string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = contamination(spark, docs, items).collect()
    assert order((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got) == order(brute(rows, [(1, "ALPHA beta gamma")]))
    left = drop_contaminated(spark, docs, items)
    assert left.columns == docs.columns and left.count() == docs.count() - sum(r.contaminated for r in got)
    assert contamination(spark, empty(spark), items).count() == 0
    none = contamination(spark, docs, items.limit(0))
    assert none.count() == docs.count() and none.filter("n_hit > 0 OR contaminated").count() == 0


def test_spans_and_proximity(spark):
    docs = spark.createDataFrame([(1, "p q r a b c s"), (2, "c x b x a"), (3, "a " + "x " * 40 + "b c")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c")], "item_id long, text string")
    with Scratch(spark) as s:
        bench = read_items(items, s)
        vocab, index = build_index(docs, bench.select(F.explode("words").alias("term")).distinct(), s)
        terms = _item_terms(bench, vocab, index, s)
        spans = [(r.d, r.start, r.end) for r in phrase_matches(index, bench, terms, s).collect()]
        near = {r.d for r in proximity_matches(index, bench, terms, s, near_terms=3, slop=5).collect()}
    assert spans == [(1, 3, 5)] and near == {1, 2}
