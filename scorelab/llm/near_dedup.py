"""Near-duplicate classes by MinHash bands and sequential Bayesian verification.

1. Every text becomes its set of word shingles, a digest of that set, and 32
   band keys of a 160-value MinHash signature (one pass, Python over Arrow).
   A pair at similarity 0.8 shares no band with probability 3e-6, one at 0.3
   shares some with probability 0.075.
2. Documents with equal sets form one class (a grouped minimum, so a huge group
   of copies costs one row per task); from here on only classes are compared.
3. Classes that share a band key (a bucket) are candidates, and no other pair is
   ever compared.  First every member of a bucket meets the bucket's least
   member, its hub: one row per distinct (hub, member), so the work is linear in
   the bucket, and a hub of very many members is dealt over chunks.
4. A bucket whose other members the links found so far leave in several
   components is open: its members of different components are compared with
   each other, each pair only in the first band that it shares.  An open bucket
   heavier than ``unit_weight`` is cut into chunks of components, compared
   crosswise but for the crosses inside one component, so that a huge family
   costs its size once.
5. A pair is compared by signature batches of 32 values.  After each batch it is
   dropped when the posterior probability that its similarity reaches the
   threshold (uniform prior, binomial matches) is below ``miss``.  Survivors are
   verified on their full shingle sets; a pair already joined by verified links
   is skipped.
6. Connected components of the verified links give the classes.

Defined results: null or empty texts (no word) have an empty set and link with
nothing; fewer than ``k`` words make one shingle of the whole sequence; repeated
rows (same id, same or other text) are documents of their own that link by
their texts; a null id never names a component unless the whole component has
none; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import Scratch, checked_broadcast, components, fresh_names, join_hot

BANDS, ROWS, BATCH = 32, 5, 32
N_HASH = BANDS * ROWS
_RNG = np.random.default_rng(20240229)
MULT = (_RNG.integers(0, 2**31, N_HASH, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
ADD = _RNG.integers(0, 2**32, N_HASH, dtype=np.uint32)
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(raw: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles of a UTF-8 text.

    ``bytes.lower`` lower-cases A-Z only and ``bytes.split`` cuts at space and
    \\t \\n \\v \\f \\r: words are ``[^\\x20\\x09-\\x0D]+`` of the lower-cased text.
    """
    words = raw.lower().split() if raw else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, n)
    if n < k:  # the whole sequence as one shingle; the length keeps it apart from others
        acc = np.array([n], np.uint64)
        for x in h:
            acc = _mix(acc * MIX + x)
        return acc
    m = n - k + 1
    acc = h[:m].copy()
    for j in range(1, k):
        acc = (acc ^ (acc >> np.uint64(29))) * MIX + h[j:j + m]
    return np.unique(_mix(acc))


def signature(s: np.ndarray, step: int = 1024) -> np.ndarray:
    """MinHash values of a non-empty set (multiply-add mod 2**32 on folded hashes)."""
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    out = None
    for i in range(0, len(x), step):
        low = (MULT[:, None] * x[None, i:i + step] + ADD[:, None]).min(axis=1)
        out = low if out is None else np.minimum(out, low)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    acc = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in sig.reshape(BANDS, ROWS).T:
        acc = _mix(acc * MIX + column)
    return acc.view(np.int64)


def least_matches(n: int, t: float, miss: float) -> int:
    """Fewest matches of ``n`` with P(similarity >= t | matches) >= ``miss``.

    Under a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper
    tail at t equals P(Binomial(n + 1, t) <= m).
    """
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def _describe(k: int):
    """Arrow batches (id, _h, text as bytes) to (id, _h, n, digest, bands)."""
    def run(batches):
        for b in batches:
            n, digest, bands = [], [], []
            for raw in b.column(2).to_pylist():
                s = shingles(raw, k)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(band_keys(signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))], names=["id", "_h", "n", "digest", "bands"])
    return run


def _pairs(sig: np.ndarray, left: np.ndarray, split: int, band: int, need: list[int], block: int = 64):
    """Per row: the later rows that survive every signature batch.

    With ``split`` only rows before it meet rows from it on.  Pairs that share a
    band before ``band`` are left out: they meet there.
    """
    m = len(sig)
    for i0 in range(0, split or m, block):
        rows = np.arange(i0, min(i0 + block, split or m))
        j0 = split or i0
        hit = (sig[rows, None, :BATCH] == sig[None, j0:, :BATCH]).sum(axis=2, dtype=np.int16)
        x, y = np.nonzero((hit >= need[0]) & (left[rows][:, None] != left[None, j0:]))
        got = hit[x, y].astype(np.int64)
        x, y = x + i0, y + j0
        later = y > x
        x, y, got = x[later], y[later], got[later]
        for b in range(1, N_HASH // BATCH):
            if not len(x):
                break
            cut = slice(b * BATCH, (b + 1) * BATCH)
            got = got + (sig[x, cut] == sig[y, cut]).sum(axis=1)
            live = got >= need[b]
            x, y, got = x[live], y[live], got[live]
        if band and len(x):
            same = (sig[x, :band * ROWS] == sig[y, :band * ROWS]).reshape(len(x), band, ROWS)
            new = ~same.all(axis=2).any(axis=1)
            x, y = x[new], y[new]
        for i in np.unique(x):
            yield int(i), y[x == i]


def verified_links(sets: list[np.ndarray], known: np.ndarray, split: int, band: int, num: int, den: int,
                   need: list[int]) -> list[tuple[int, int]]:
    """Links that join the given classes beyond ``known`` components (a spanning forest).

    Pairs of one known component, pairs that share a band before ``band`` and,
    with ``split``, pairs on one side of it are left out.
    """
    if len(sets) < 2:
        return []
    sig = np.stack([signature(s) for s in sets])
    size = np.array([len(s) for s in sets])
    start = np.concatenate(([0], np.cumsum(size)))
    _, word = np.unique(np.concatenate(sets), return_inverse=True)
    flag = np.zeros(int(word.max()) + 1, bool)
    label = np.unique(known, return_inverse=True)[1].copy()
    out = []
    for i, ys in _pairs(sig, label.copy(), split, band, need):
        lo, hi = np.minimum(size[i], size[ys]), np.maximum(size[i], size[ys])
        ys = ys[(label[ys] != label[i]) & (den * lo >= num * hi)]
        if not len(ys):
            continue
        own = word[start[i]:start[i + 1]]
        flag[own] = True
        both = np.add.reduceat(flag[np.concatenate([word[start[y]:start[y + 1]] for y in ys])],
                               np.concatenate(([0], np.cumsum(size[ys])[:-1])), dtype=np.int64)
        flag[own] = False
        for y in ys[den * both >= num * (size[i] + size[ys] - both)]:
            if label[y] != label[i]:
                out.append((i, int(y)))
                label[label == label[y]] = label[i]
    return out


def _links(k: int, num: int, den: int, miss: float):
    """One unit (rows unit, cluster, band, rid, known, side, text) to its links (a, b)."""
    need = [least_matches(BATCH * (b + 1), num / den, miss) for b in range(N_HASH // BATCH)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, g in pdf.groupby(["cluster", "band"], sort=False):
            g = g.drop_duplicates("rid").sort_values("side", kind="stable")
            rid, side = g["rid"].to_numpy(), g["side"].to_numpy()
            split = int((side == 0).sum()) if side[-1] else 0
            if side[0]:
                continue
            sets = [shingles(t.encode(), k) for t in g["text"]]
            for x, y in verified_links(sets, g["known"].to_numpy(), split, int(g["band"].iat[0]), num, den, need):
                a.append(rid[x])
                b.append(rid[y])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})
    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    k: int = 5, num: int = 80, den: int = 100, miss: float = 1e-6,
                    unit_weight: int = 1_000_000) -> DataFrame:
    """Per row of ``docs``: id, text_hash (xxhash64 of the text), n_shingles, component_id, kept.

    Two documents link when ``den * |A and B| >= num * |A or B|`` for their sets
    of ``k``-word shingles.  ``component_id`` is the least id of the document's
    component and ``kept`` says that it is the document's own.  The result is a
    written table.  See the module text for the method and the special cases.
    """
    key = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("text"))
    id_type = key.schema["id"].dataType
    with Scratch(spark) as scratch:
        out = T.StructType([T.StructField("id", id_type), T.StructField("_h", T.LongType()),
                            T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()),
                            T.StructField("bands", T.ArrayType(T.LongType()))])
        rows = scratch.write(key.select("id", "_h", F.col("text").cast("binary").alias("text"))
                             .mapInArrow(_describe(k), out)
                             .withColumn("rid", F.monotonically_increasing_id()), "sets")
        full = rows.filter("n > 0")
        classes = full.groupBy("digest").agg(F.min("rid").alias("rid"), F.min("id").alias("least_id"))
        reps = scratch.write(full.join(classes.select("rid"), "rid", "left_semi")
                             .select("rid", "id", "_h", "n", "bands"), "reps")

        repeats = not full.groupBy("id", "_h").count().filter("count > 1").isEmpty()
        shared = shared_buckets(reps, scratch)
        compare = _links(k, num, den, miss)
        links = _compare(key, hub_units(shared, unit_weight), repeats, scratch, compare)
        found = components(spark, links, scratch)
        more = open_units(shared, found, scratch, unit_weight)
        if more:
            links = links.union(_compare(key, more, repeats, scratch, compare))
        linked = components(spark, links, scratch)
        roots = (classes.join(linked, classes.rid == linked.node, "left")
                        .select("digest", "least_id", F.coalesce("root", "rid").alias("root")))
        least = roots.groupBy("root").agg(F.min("least_id").alias("component_id"))
        of_set = roots.join(least, "root").select("digest", "component_id")
        res = rows.join(of_set, "digest", "left").select(
            "id", "_h", "n", F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
        return scratch.write(res.select(
            F.col("id").alias(id_col), F.col("_h").alias("text_hash"), F.col("n").alias("n_shingles"), "component_id",
            F.col("id").eqNullSafe(F.col("component_id")).alias("kept")), "classes", keep=True)


def shared_buckets(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """Members of buckets of two or more classes: band, bucket, hub (the least member), rid, id, _h, w (weight)."""
    member = reps.select("rid", "id", "_h", (F.col("n") + 200).alias("w"), F.posexplode("bands").alias("band", "bucket"))
    hubs = scratch.write(member.groupBy("bucket").agg(F.min("rid").alias("hub"), F.max("rid").alias("other"),
                                                      F.count("*").alias("m")).filter("hub <> other").drop("other"), "hubs")
    return scratch.write(join_hot(member, hubs, ["bucket"], "m").filter("hub IS NOT NULL").drop("m"), "shared")


def _packs(weight: int | None, unit_weight: int) -> int:
    """Number of units that light groups of this total weight are packed into."""
    return int((weight or 0) // unit_weight) * 4 + 1


def hub_units(shared: DataFrame, unit_weight: int) -> DataFrame:
    """Every distinct (hub, member) once, in units.

    A hub whose members weigh more than ``unit_weight`` is copied to each chunk of them.
    """
    spoke = shared.filter("rid <> hub").select("hub", "rid", "id", "_h", "w").distinct()
    sums = spoke.groupBy("hub").agg(F.sum("w").alias("weight"))
    own = shared.filter("rid = hub").select("hub", "id", "_h").distinct()
    total = shared.filter("rid <> hub").agg(F.sum("w")).first()[0]
    packs = _packs(total, unit_weight)
    chunks = F.ceil(F.col("weight") / unit_weight)
    unit = F.when(F.col("chunks") == 1, F.concat(F.lit("s"), F.pmod(F.xxhash64("hub"), F.lit(packs)).cast("string"))) \
            .otherwise(F.concat_ws("/", "hub", "chunk"))
    heavy = F.broadcast(sums.filter(chunks > 1).select("hub", chunks.alias("chunks")))  # at most total / unit_weight rows
    one = F.coalesce("chunks", F.lit(1)).alias("chunks")
    spokes = (spoke.join(heavy, "hub", "left").select("hub", "rid", "id", "_h", one)
                   .withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("chunks"))).withColumn("side", F.lit(1)))
    hubs = (own.join(heavy, "hub", "left").select("hub", F.col("hub").alias("rid"), "id", "_h", one)
               .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).withColumn("side", F.lit(0)))
    return hubs.unionByName(spokes).select(unit.alias("unit"), F.concat_ws("/", "hub", "chunk").alias("cluster"),
                                           F.lit(0).alias("band"), "rid", F.col("rid").alias("known"), "side", "id", "_h")


def open_units(shared: DataFrame, found: DataFrame, scratch: Scratch, unit_weight: int) -> DataFrame | None:
    """Members of open buckets, in units; None when every bucket is closed.

    The hub is left out: it has met every member.  ``found``: components (node, root) of the links so far.
    """
    spoke = shared.filter("rid <> hub").join(found, F.col("rid") == F.col("node"), "left").select(
        "band", "bucket", "rid", "id", "_h", "w", F.coalesce("root", "rid").alias("known"))
    spoke = scratch.write(spoke, "spokes")
    bar = scratch.write(spoke.groupBy("bucket").agg(F.min("known").alias("lo"), F.max("known").alias("hi"), F.sum("w").alias("weight"),
                                                    F.count("*").alias("m")).filter("lo <> hi").drop("lo", "hi"), "open")
    total = bar.agg(F.sum("weight"), F.max("weight")).first()
    if total[0] is None:
        return None
    packs = _packs(total[0], unit_weight)
    inside = scratch.write(join_hot(spoke, bar, ["bucket"], "m").filter("weight IS NOT NULL").drop("m"), "inside")
    cluster = F.col("bucket").cast("string").alias("cluster")
    out = ["unit", "cluster", "band", "rid", "known", "side", "id", "_h"]
    small = inside.filter(F.col("weight") <= unit_weight).select(
        F.concat(F.lit("s"), F.pmod(F.xxhash64("bucket"), F.lit(packs)).cast("string")).alias("unit"),
        cluster, "band", "rid", "known", F.lit(0).alias("side"), "id", "_h")
    if total[1] <= unit_weight:
        return small.select(*out)
    # Chunks of a heavy bucket: a large component is cut into chunks of its own, small ones are pooled.
    heavy = inside.filter(F.col("weight") > unit_weight)
    half = unit_weight / 2
    comp = heavy.groupBy("bucket", "known").agg(F.sum("w").alias("cw"), F.count("*").alias("cm"))
    comp = scratch.write(comp, "comp")
    pool = comp.filter(F.col("cw") <= half).groupBy("bucket").agg(F.sum("cw").alias("pw"))
    comp = scratch.write(comp.join(pool, "bucket", "left"), "pooled")
    big = F.col("cw") > half
    chunked = scratch.write(join_hot(heavy, comp, ["bucket", "known"], "cm").select(
        cluster, "band", "rid", "id", "_h", "known",
        F.when(big, F.concat_ws("/", F.lit("c"), "known", F.pmod(F.xxhash64("rid"), F.ceil(F.col("cw") / half))))
        .otherwise(F.concat_ws("/", F.lit("p"), F.pmod(F.xxhash64("known"), F.ceil(F.col("pw") / half)))).alias("chunk"),
        F.when(big, F.col("known")).alias("whole")), "chunked")
    chunks = chunked.select("cluster", "chunk", "whole").distinct()
    l, r = chunks.alias("l"), chunks.alias("r")
    crosses = l.join(r, (F.col("l.cluster") == F.col("r.cluster")) & (F.col("l.chunk") <= F.col("r.chunk"))
                     & ~F.coalesce(F.col("l.whole") == F.col("r.whole"), F.lit(False)))
    crosses = scratch.write(crosses.select(F.col("l.cluster").alias("cluster"), F.col("l.chunk").alias("lc"),
                                           F.col("r.chunk").alias("rc"),
                                           F.concat_ws("|", "l.cluster", "l.chunk", "r.chunk").alias("unit")), "crosses")
    first = chunked.join(crosses.withColumn("chunk", F.col("lc")), ["cluster", "chunk"]).withColumn("side", F.lit(0))
    second = chunked.join(crosses.filter("lc <> rc").withColumn("chunk", F.col("rc")), ["cluster", "chunk"]).withColumn("side", F.lit(1))
    return small.select(*out).union(first.select(*out)).union(second.select(*out))


def _compare(key: DataFrame, placed: DataFrame, repeats: bool, scratch: Scratch, links) -> DataFrame:
    """Adds the texts of the placed classes and runs the comparison per unit: links (a, b).

    ``repeats``: some rows have id and text in common; one of each is kept before the units are shuffled.
    """
    placed = scratch.write(placed, "placed")
    same = (F.col("d._h") == F.col("p._h")) & F.col("d.id").eqNullSafe(F.col("p.id"))
    rows = key.alias("d").join(checked_broadcast(placed).alias("p"), same).select(
        "p.unit", "p.cluster", "p.band", "p.rid", "p.known", "p.side", "d.text")
    if repeats:
        of_class = ["unit", "cluster", "band", "rid", "known", "side"]
        rows = rows.groupBy(*of_class).agg(F.first("text").alias("text"))
    return scratch.write(rows.groupBy("unit").applyInPandas(links, "a long, b long"), "links")


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` with one document of each near-duplicate group (the least id), all columns kept.

    Rows dropped are found by (id, text hash) and removed by an anti join; of
    rows repeated whole under one kept id one stays.  Documents without words
    stay.  Of several texts under the kept id that link with each other, the
    least text hash stays.
    """
    classes = near_duplicates(spark, docs, id_col, text_col, **params)
    with Scratch(spark) as scratch:
        groups = classes.filter("n_shingles > 0 AND kept").groupBy(id_col, "component_id").agg(
            F.min("text_hash").alias("stay"))
        own_id, own_hash = fresh_names(docs, "__id", "__hash")
        drop = (classes.filter("n_shingles > 0").alias("c")
                .join(groups.alias("g"), F.col(f"c.{id_col}").eqNullSafe(F.col(f"g.{id_col}"))
                      & F.col("c.component_id").eqNullSafe(F.col("g.component_id")), "left")
                .filter(~F.coalesce(F.col("c.text_hash") == F.col("g.stay"), F.lit(False)))
                .select(F.col(f"c.{id_col}").alias(own_id), F.col("c.text_hash").alias(own_hash)).distinct())
        drop = scratch.write(drop, "drop", keep=True)
        again = scratch.write(classes.filter("n_shingles > 0").groupBy(id_col, "text_hash").count().filter("count > 1")
                              .select(F.col(id_col).alias(own_id), F.col("text_hash").alias(own_hash)), "again", keep=True)
        match = F.xxhash64(text_col) == F.col(own_hash)
        match = match & F.col(id_col).eqNullSafe(F.col(own_id))
        left = docs.join(checked_broadcast(drop), match, "left_anti")
        if again.isEmpty():
            return left
        once = left.join(checked_broadcast(again), match, "left_anti")
        more = left.join(checked_broadcast(again), match, "left_semi").withColumn(own_hash, F.xxhash64(text_col))
        return once.unionByName(more.dropDuplicates([id_col, own_hash]).drop(own_hash))
