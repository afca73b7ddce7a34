"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import re
from collections import Counter, defaultdict

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, score string, rid int, id string, __note string"


def messy(spark, extra=()):
    """documents with extra columns named like inner ones."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    texts = [(1, None), (2, ""), (3, "  \t\n "), (4, "One two"), (5, "one TWO"), (6, base), (6, base), (7, base + " nu"), (None, base),
             (None, None), (8, "word " * 30_000), (9, "word " * 30_000), (10, "Été ÉTÉ été"), (11, "a,b;c"), (12, "12 34 56"), *extra]
    rows = [(i, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, None, 7, "x", "y", 1, "z", "n") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingle_set(text, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", ascii_lower(text)) if x]
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def near_classes(rows, k, num=80, den=100):
    """Brute force: per (id, text) the size of its set and the least id of its component."""
    sets = [shingle_set(t, k) for _, t in rows]
    at, both = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    for v in at.values():
        both.update((v[a], v[b]) for b in range(len(v)) for a in range(b))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for (a, b), n in both.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            root[max(find(a), find(b))] = min(find(a), find(b))
    ids = defaultdict(list)
    for i in range(len(rows)):
        ids[find(i)].append(rows[i][0])
    least = {r: min((x for x in v if x is not None), default=None) for r, v in ids.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))]


def order(rows):
    return sorted(rows, key=repr)
