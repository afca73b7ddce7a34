"""Perplexity rules: the model, the counts and the verdicts against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from scorelab.llm import perplexity as P
from scorelab.llm.common import Scratch

from .util import empty, messy

ORDER = 5


def fold(text):
    return "".join(" " if ord(c) < 32 or ord(c) == 127 else "0" if "0" <= c <= "9" else c.lower() if "A" <= c <= "Z" else c for c in text)


def windows(text, k=ORDER):
    s = "\x01" * (k - 1) + fold(text) + "\x02"
    return [s[i:i + k] for i in range(len(s) - k + 1)]


def brute_model(texts, k=ORDER):
    """Interpolated modified Kneser-Ney probabilities of the highest order, by definition."""
    counts = {k: Counter(w for t in texts for w in windows(t, k))}
    for n in range(k - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    probs = {}
    for n in range(1, k + 1):
        c = counts[n]
        many = Counter(c.values())
        y = many[1] / (many[1] + 2 * many[2]) if many[1] + many[2] else None
        d = [max(i - (i + 1) * y * many[i + 1] / many[i], 0) if many[i] and y is not None else .5 for i in (1, 2, 3)]
        total, mass, kinds = Counter(), Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            mass[g[:-1]] += d[min(v, 3) - 1]
            kinds[g[:-1]] += 1
        low = probs
        probs = {g: (v - d[min(v, 3) - 1] + mass[g[:-1]] * (low[g[1:]] if n > 1 else 1 / (kinds[""] + 1))) / total[g[:-1]] for g, v in c.items()}
    return probs


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i:i + 3])].append(i)
    repeat = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat)


def quantile(values, p):
    v = sorted(values)
    at = p * (len(v) - 1)
    lo = math.floor(at)
    return v[lo] + (v[min(lo + 1, len(v) - 1)] - v[lo]) * (at - lo)


def brute(rows, reach=3.0):
    """(id, counts, base_failed, log perplexity, kept) per (id, text, lang) row."""
    models = {}
    for lang in {r[2] or "" for r in rows}:
        models[lang] = brute_model([t for _, t, x in rows if (x or "") == lang and t is not None])
    out = []
    for i, t, lang in rows:
        c = brute_counts(t)
        w = windows(t) if t is not None else []
        lp = round(-sum(math.log(models[lang or ""][g]) for g in w) / len(w), 4) if w else None
        out.append([i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0], lp, lang or ""])
    good = defaultdict(list)
    for *_, failed, lp, lang in out:
        if not failed:
            good[lang].append(lp)

    def kept(failed, lp, lang):
        if failed:
            return False
        a, b = quantile(good[lang], .25), quantile(good[lang], .75)
        return a - reach * (b - a) <= lp <= b + reach * (b - a)
    return sorted(((*r[:8], kept(*r[6:])) for r in out), key=repr)


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def corpus():
    rng = random.Random(3)
    en, fr = [["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(120)] for letters in ("etaoinsh", "éàlesrmn")]
    extra = [(30 + i, prose(rng, rng.randint(50, 120), en if i % 3 else fr).capitalize()) for i in range(60)]
    extra += [(200, prose(rng, 60, en) + " " + "# $ % & zq9 " * 30), (201, "line one two\n\nline one two\nline  one two\n" + prose(rng, 60, en)),
              (202, "".join(chr(rng.randint(0x4e00, 0x9fff)) + (" " if i % 3 == 0 else "") for i in range(400))), (203, "a\x00b \x1cc\x85d  e\x7f f 😀 g " * 3)]
    return extra


def results(res):
    cols = ["doc_id", *P.COUNTS, "base_failed", "perplexity", "kept"]
    return sorted([tuple(round(math.log(v), 4) if c == "perplexity" and v is not None else v for c, v in zip(cols, [r[c] for c in cols])) for r in res.collect()], key=repr)


@pytest.mark.parametrize("params", [{}, {"max_entries": 10}])
def test_verdicts_against_brute_force(spark, params, monkeypatch):
    """Chunks of few characters, few held n-grams; the model sent as arrays and joined as a table."""
    monkeypatch.setattr(P, "CHUNK", 5_000)
    monkeypatch.setattr(P, "MAX_HELD", 2_000)
    docs = messy(spark, corpus())
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    got, want = results(P.assess(spark, docs, **params)), brute(rows)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    for g, w in zip(got, want):
        assert (g[7] is None) == (w[7] is None) and (g[7] is None or abs(g[7] - w[7]) < 2e-4)
    assert [(g, w) for g, w in zip(got, want) if g[8] != w[8]] == []
    assert {w[8] for w in want} == {True, False}


def test_probabilities_sum_to_one(spark):
    """In every context, the seen symbols' probabilities and what is left for unseen ones."""
    texts = [(1, "en", "banana bandana"), (2, "en", "ban a cabana"), (3, "de", "ananas"), (4, "de", None), (5, "en", "")]
    docs = spark.createDataFrame(texts, "id long, lang string, text string")
    with Scratch(spark) as scratch:
        counts = scratch.write(P.gram_counts(docs, 3))
        got = {(r.lang, r.gram): r.p for r in P.kneser_ney(counts, 3, scratch).collect()}
        low = {(r.lang, r.gram): (r.p, r.c) for r in P.interpolated(counts.selectExpr("lang", "substring(gram, 3, 1) gram").groupBy("lang", "gram").count()
                                                                    .withColumnRenamed("count", "c"), None, 1).collect()}
    for lang, own in (("en", ["banana bandana", "ban a cabana", ""]), ("de", ["ananas"])):
        want = brute_model(own, 3)
        assert {g for x, g in got if x == lang} == set(want)
        assert all(abs(got[lang, g] - p) < 1e-12 for g, p in want.items())
        kinds = sum(x == lang for x, _ in low)
        left = 1 - sum(p for (x, _), (p, _) in low.items() if x == lang)
        assert 0 < left < 1 and kinds == len(set("".join(map(fold, own)))) + 1


def test_hashes_of_spark_and_tasks_agree(spark):
    symbols, key, text = P.grams(["Ab1", "", "é😀"], ["en", "de", ""], 3)
    model = spark.createDataFrame([("en", "\x01\x01a", 1, .5), ("en", "ab0", 1, .5), ("", "é😀\x02", 1, .5), ("de", "\x01\x01\x02", 1, .5)], "lang string, gram string, c long, p double")
    got = {r.key & (2 ** 64 - 1) for r in P.hashed(model, 3).collect()}
    assert got <= {int(k) for k, t in zip(key, text) if t >= 0} and len(got) == 4


def test_empty_tables(spark):
    assert P.assess(spark, empty(spark)).count() == 0
    nulls = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    row = P.assess(spark, nulls).first()
    assert row.base_failed and not row.kept and row.perplexity is None


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "ab cd " * 600_000, "en"), (2, "x", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in P.assess(spark, docs).collect()}
    assert got[1].n_words == got[1].n_repeat_words == 1_200_000 and got[1].base_failed
