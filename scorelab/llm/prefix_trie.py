"""Trie of shared conversation prefixes, screened by a count-min sketch.

A node is a distinct sequence of first turns (role, text); its members are the
conversations that start with it.  A prefix is named by a 128-bit digest: the
exclusive or of hashes of (position, turn hash), so that digests of all prefixes
are one running total over a conversation.

A count-min sketch of all prefix digests comes first.  It never counts too low, so
an estimate of one proves that no other conversation has the prefix: such a node
is emitted from its own row, without meeting any other.  Only the rows of possibly
shared prefixes are shuffled and grouped exactly.  The sketch's size is bounded
(``max_cells``); a fuller sketch screens less and changes no result.

Sums over subtrees need no walk: every node is owned by its smallest member; the
nodes that a conversation owns are the end of its path.  A subtree's sum is the
owner's own sum from that depth on plus the whole own sums of the other members
that do not own the node (each of those lies below it).

Running totals go over range partitions with carried totals (``running``), and
lookups treat keys on very many rows apart (``join_hot``), so neither a very long
conversation nor a very common prefix fills one task.

Defined results: a null role or text is the empty string; turns of a conversation
are ordered by turn (null first), equal turns by their hash; repeated rows are
turns of their own; rows without a conversation id belong to none and are left
out; a conversation without turns is a member of the root; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.select import range_partitions
from .common import Scratch, join_hot

KEY = ["k1", "k2", "d"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: Odd multipliers of the sketch's two rows.
ROWS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: The sketch travels in pieces of so many cells, joined conversation ids in pieces of so many bytes.
PIECE_CELLS = 1 << 16
PIECE_BYTES = 1 << 20


# ---------------------------------------------------------------- running totals

def running(df: DataFrame, scratch: Scratch, key: str, order: list[Column], totals: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` (read from a written table, whose size sets the partitions) with running
    totals per ``key`` (long) in ``order``: name -> (column, "sum" or "xor").

    Rows are range-partitioned by key and order; each task adds up its own rows in
    one pass.  A key that goes on in later partitions carries its totals there
    through a table of one row per partition.
    """
    names = list(totals)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry, at = None, dict.fromkeys(names, 0), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            new = np.flatnonzero(np.concatenate([[keys[0] != last], keys[1:] != keys[:-1]]))
            part = np.zeros(len(keys), np.int64)
            part[new] = 1
            part = np.cumsum(part)  # 0: goes on from the batch before
            cols = []
            for n in names:
                column, op = totals[n]
                v = batch.column(column).to_numpy().astype(np.int64)
                run = np.bitwise_xor.accumulate(v) if op == "xor" else np.cumsum(v)
                before = np.concatenate([[np.int64(0)], (run - v if op == "sum" else run ^ v)[new]])[part]
                run = run ^ before if op == "xor" else run - before
                run = np.where(part == 0, run ^ carry[n] if op == "xor" else run + carry[n], run)
                carry[n] = run[-1]
                cols.append(pa.array(run))
            last = keys[-1]
            idx = pa.array(np.arange(at, at + len(keys)))
            at += len(keys)
            yield pa.RecordBatch.from_arrays(batch.columns + cols + [idx], names=batch.schema.names + [*names, "at"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    parts = range_partitions(df)
    ranged = df.repartitionByRange(parts, F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    done = ranged.mapInArrow(scan, f"{fields}, {', '.join(f'{n} bigint' for n in names)}, at bigint")
    done = scratch.write(done.withColumn("pid", F.spark_partition_id()), "running")
    ends = done.groupBy("pid").agg(F.min_by(key, "at").alias("first"), F.max_by(F.struct(key, *names), "at").alias("end"))
    w = Window.partitionBy("k").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    both = ends.select("pid", F.col(f"end.{key}").alias("k"), *[F.col(f"end.{n}").alias(n) for n in names], F.lit(True).alias("ends")).union(
        ends.filter(F.col("first") != F.col(f"end.{key}")).select("pid", "first", *[F.lit(0).cast("long")] * len(names), F.lit(False)))
    # One or two rows per partition: a bounded broadcast.
    add = both.select("pid", F.col("k").alias(key), *[F.coalesce((F.bit_xor if totals[n][1] == "xor" else F.sum)(n).over(w), F.lit(0)).alias(f"_{n}") for n in names])
    out = done.join(F.broadcast(add), ["pid", key], "left")
    fix = [(F.col(n).bitwiseXOR(F.coalesce(f"_{n}", F.lit(0))) if totals[n][1] == "xor" else F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in names]
    return out.select(*df.columns, *fix)


# ---------------------------------------------------------------- rebuilt conversations

def numbered_turns(convs: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, pos, turn_hash, bytes): every turn with its place from 1; texts stay behind."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = convs.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.unhex(F.sha2(name, 256)).alias("turn_hash"),
        F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("one"), F.monotonically_increasing_id().alias("rid"))
    rows = scratch.write(rows, "turns")  # pins rid, which parts rows that are equal in all else
    placed = running(rows, scratch, "conv", [F.col("turn").asc_nulls_first(), F.col("turn_hash"), F.col("rid")], {"pos": ("one", "sum")})
    return scratch.write(placed.select("conv", "pos", "turn_hash", "bytes"), "placed")


def rebuilt(convs: DataFrame, scratch: Scratch, block: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (conv, d, turn_hash, bytes, last) and every conversation's length (conv, length).

    Conversation c gets the first h turns of conversation c - c % block, then its
    own after its first h; h is crc32 of its decimal id modulo ``most``.
    """
    turns = numbered_turns(convs, scratch)
    ids = scratch.write(turns.groupBy("conv").agg(F.max("pos").alias("n")), "ids")
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h")
    ids = ids.select("conv", "n", h, (F.col("conv") - F.col("conv") % block).alias("base"))
    ids = ids.join(ids.select(F.col("conv").alias("base"), F.col("n").alias("n_base")), "base", "left")
    ids = ids.withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    ids = scratch.write(ids.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "lengths")
    own = join_hot(turns, ids.select("conv", "n", "h", "taken", "length"), ["conv"], "n").filter("pos > h")
    own = own.select("conv", (F.col("taken") + F.col("pos") - F.col("h")).alias("d"), "turn_hash", "bytes", "length")
    # At most most - 1 turns of a base meet at most 2 * block - 1 conversations.
    head = turns.filter(F.col("pos") < most).withColumnRenamed("conv", "base").join(ids.select("conv", "base", "h", "length"), "base").filter("pos <= h")
    rows = own.union(head.select("conv", F.col("pos").alias("d"), "turn_hash", "bytes", "length"))
    return rows.withColumn("last", F.col("d") == F.col("length")).drop("length"), ids.select("conv", "length")


def prefixes(rows: DataFrame, lengths: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, d, k1, k2, p1, p2, bytes, last): every prefix of every conversation, from the root (d = 0); p: its parent's digest."""
    x1, x2 = F.xxhash64("d", "turn_hash").alias("x1"), F.xxhash64("turn_hash", "d", F.lit("second")).alias("x2")
    rows = scratch.write(rows.select("conv", "d", x1, x2, "bytes", "last"), "rebuilt")
    run = running(rows, scratch, "conv", [F.col("d")], {"k1": ("x1", "xor"), "k2": ("x2", "xor")})
    run = run.select("conv", "d", "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "bytes", "last")
    zero = F.lit(0).cast("long")
    root = lengths.select("conv", zero.alias("d"), zero.alias("k1"), zero.alias("k2"), zero.alias("p1"), zero.alias("p2"), zero.alias("bytes"), (F.col("length") == 0).alias("last"))
    return scratch.write(run.unionByName(root), "prefixes")


# ---------------------------------------------------------------- count-min screening

def cells(k1: np.ndarray, k2: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each digest in every row of a sketch of 2 ** bits cells a row."""
    a, b = k1.view(np.uint64), k2.view(np.uint64)
    return [((a ^ (b * np.uint64(m | 2))) * np.uint64(m) >> np.uint64(64 - bits)).astype(np.int64) for m in ROWS]


def count_min(rows: DataFrame, bits: int) -> np.ndarray:
    """Sketch of the digests of ``rows``: one byte per cell, which stays at 255 once there.

    Each task counts its rows; the pieces of the tasks' sketches are added up by
    place.  What reaches the driver has 2 * 2 ** bits bytes, whatever the rows.
    """
    def part(batches):
        sketch = np.zeros((len(ROWS), 1 << bits), np.uint8)
        for batch in batches:
            for row, at in zip(sketch, cells(batch.column("k1").to_numpy(), batch.column("k2").to_numpy(), bits)):
                u, n = np.unique(at, return_counts=True)
                row[u] = np.minimum(row[u].astype(np.int64) + n, 255)
        flat = sketch.reshape(-1)
        for i in range(0, flat.size, PIECE_CELLS):
            if flat[i:i + PIECE_CELLS].any():
                yield pa.RecordBatch.from_pydict({"piece": pa.array([i], pa.int64()), "data": pa.array([flat[i:i + PIECE_CELLS].tobytes()], pa.binary())})

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column("piece").to_pylist(), batch.column("data").to_pylist()):
                got = np.frombuffer(data, np.uint8).astype(np.int64)
                held[i] = np.minimum(held[i] + got, 255).astype(np.uint8) if i in held else got.astype(np.uint8)
        for i, v in held.items():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([i], pa.int64()), "data": pa.array([v.tobytes()], pa.binary())})

    schema = "piece bigint, data binary"
    merged = rows.select("k1", "k2").mapInArrow(part, schema).repartition("piece").mapInArrow(add, schema)
    flat = np.zeros(len(ROWS) << bits, np.uint8)
    for row in merged.toLocalIterator():
        flat[row.piece:row.piece + len(row.data)] = np.frombuffer(row.data, np.uint8)
    return flat.reshape(len(ROWS), -1)


def screened(spark: SparkSession, rows: DataFrame, max_cells: int = 1 << 22) -> DataFrame:
    """``rows`` with ``alone`` (the sketch proves that no other conversation has the prefix) and ``above_alone`` (its parent's)."""
    bits = (int(np.clip(4 * rows.count(), 1 << 12, max_cells)) - 1).bit_length()
    sketch = spark.sparkContext.broadcast(count_min(rows, bits))

    def look(batches):
        for batch in batches:
            col = {n: batch.column(n).to_numpy() for n in ("d", "k1", "k2", "p1", "p2")}

            def one(a, b):
                return np.minimum(*[row[at] for row, at in zip(sketch.value, cells(a, b, bits))]) == 1
            # The root is never screened.
            alone = one(col["k1"], col["k2"]) & (col["d"] > 0)
            above = one(col["p1"], col["p2"]) & (col["d"] > 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(alone), pa.array(above)], names=[*batch.schema.names, "alone", "above_alone"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(look, f"{fields}, alone boolean, above_alone boolean")


# ---------------------------------------------------------------- exact nodes

def ends_digest(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(k1, k2, d, sha): SHA-256 of each node's ascending comma-joined ids, from (k1, k2, d, conv) rows.

    Ids are joined in range partitions by (node, id), in pieces of bounded size;
    then one pass over a node's few pieces feeds them to the hash one by one.
    """
    def join(batches):
        node, first, ids, size = None, None, [], 0

        def out():
            return pa.RecordBatch.from_pydict({**{n: pa.array([v], pa.int64()) for n, v in zip([*KEY, "first"], [*node, first])},
                                               "piece": pa.array([",".join(ids).encode()], pa.binary())})
        for batch in batches:
            for *at, conv in zip(*[batch.column(n).to_pylist() for n in [*KEY, "conv"]]):
                if at != node or size > PIECE_BYTES:
                    if ids:
                        yield out()
                    node, first, ids, size = at, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
        if ids:
            yield out()

    def digest(batches):
        node, sha = None, None

        def out():
            return pa.RecordBatch.from_pydict({**{n: pa.array([v], pa.int64()) for n, v in zip(KEY, node)}, "sha": pa.array([sha.hexdigest()])})
        for batch in batches:
            for *at, piece in zip(*[batch.column(n).to_pylist() for n in [*KEY, "piece"]]):
                if at != node:
                    if node:
                        yield out()
                    node, sha = at, hashlib.sha256(piece)
                else:
                    sha.update(b"," + piece)
        if node:
            yield out()

    rows = rows.select(*KEY, "conv")
    ranged = rows.repartitionByRange(range_partitions(rows), *KEY, "conv").sortWithinPartitions(*KEY, "conv")
    pieces = scratch.write(ranged.mapInArrow(join, "k1 bigint, k2 bigint, d bigint, first bigint, piece binary"), "pieces")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, "k1 bigint, k2 bigint, d bigint, sha string")


def shared_nodes(rows: DataFrame, heads: DataFrame, scratch: Scratch) -> DataFrame:
    """Exact nodes of the possibly shared prefixes ``rows``; ``heads``: the proved singletons right below them."""
    nodes = scratch.write(rows.groupBy(*KEY).agg(
        F.count("*").alias("n_convs"), F.min("conv").alias("owner"), F.max("bytes").alias("bytes"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
        F.sum(F.col("last").cast("long")).alias("n_ends"), F.min(F.when(F.col("last"), F.col("conv"))).alias("end")), "nodes")
    below = nodes.filter("d > 0").select("p1", "p2", "d").union(heads.select("p1", "p2", "d"))
    children = below.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("n_children"))
    return scratch.write(nodes.drop("p1", "p2").join(children, KEY, "left").fillna(0, ["n_children"]), "children")


def trie(spark: SparkSession, convs: DataFrame, block: int = 5, most: int = 9, max_cells: int = 1 << 22) -> DataFrame:
    """One row per node of the trie of ``convs`` (conv_id, turn, role, text), rebuilt as ``rebuilt`` says.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (bytes of last texts that all but one member of each
    node below repeat), ends_sha256, screened (emitted on the sketch's proof).
    """
    with Scratch(spark) as scratch:
        rows, lengths = rebuilt(convs, scratch, block, most)
        rows = scratch.write(screened(spark, prefixes(rows, lengths, scratch), max_cells), "screened")
        tails, shared = rows.filter("alone"), rows.filter("NOT alone")
        heads = tails.filter("NOT above_alone")
        nodes = shared_nodes(shared, heads, scratch)

        # Every shared prefix of a conversation with its node, and what the conversation owns in all.
        path = scratch.write(join_hot(shared.select("conv", *KEY, "last"), nodes.drop("end"), KEY, "n_convs"), "path")
        mine = F.col("owner") == F.col("conv")
        value = (F.col("n_convs") - 1) * F.col("bytes")
        owns = path.select("conv", F.lit(1).alias("n"), F.when(mine & F.col("last") & (F.col("n_children") == 0), 1).otherwise(0).alias("own_leaf"),
                           F.when(mine, value).otherwise(0).alias("own_saved"))
        owns = owns.union(tails.filter("last").select("conv", F.lit(0), F.lit(1), F.lit(0).cast("long")))
        owns = scratch.write(owns.groupBy("conv").agg(F.sum("n").alias("n"), F.sum("own_leaf").alias("own_leaf"), F.sum("own_saved").alias("own_saved")), "owns")
        path = scratch.write(join_hot(path, owns, ["conv"], "n"), "owned")

        other = path.filter(~mine).groupBy(*KEY).agg(F.sum("own_leaf").alias("o_leaf"), F.sum("own_saved").alias("o_saved"))
        own = path.filter(mine)
        deep = running(own.filter("n_convs > 1").select(*KEY, "conv", value.alias("value")), scratch, "conv", [F.col("d").desc()], {"below": ("value", "sum")})
        sums = own.select(*KEY, "own_leaf").join(other, KEY, "left").join(deep.select(*KEY, "below"), KEY, "left")
        sums = sums.select(*KEY, (F.col("own_leaf") + F.coalesce("o_leaf", F.lit(0))).alias("n_leaves"),
                           (F.coalesce("below", F.lit(0)) + F.coalesce("o_saved", F.lit(0))).alias("saved_tokens"))

        # A node's parent on its owner's path; none there: the parent was proved to be the owner's alone.
        above = path.select("conv", (F.col("d") + 1).alias("d"), F.col("owner").alias("up"))
        parents = own.filter("d > 0").select("conv", "d").union(heads.select("conv", "d")).join(above, ["conv", "d"], "left")
        parents = scratch.write(parents.select("conv", "d", F.coalesce("up", "conv").alias("parent")), "parents")
        ends = ends_digest(path.filter("last AND n_ends > 1"), scratch)

        one = F.sha2(F.col("end").cast("string"), 256)
        exact = nodes.join(sums, KEY).join(ends, KEY, "left").join(parents, (F.col("owner") == parents.conv) & (nodes.d == parents.d), "left").select(
            F.col("owner").alias("conv_id"), nodes.d.alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.when(F.col("n_ends") == 0, EMPTY_SHA).when(F.col("n_ends") == 1, one).otherwise(F.col("sha")).alias("ends_sha256"), F.lit(False).alias("screened"))
        lone = tails.join(parents, ["conv", "d"], "left").select(
            F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.coalesce("parent", "conv").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
            F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
            F.when(F.col("last"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(EMPTY_SHA).alias("ends_sha256"), F.lit(True).alias("screened"))
        return scratch.write(exact.unionByName(lone), "trie", keep=True)
