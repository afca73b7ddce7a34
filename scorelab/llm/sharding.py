"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into ``n_slots`` virtual slots (the number never changes for a
data set), the bytes of each slot are aggregated, and a map of at most
``n_slots`` rows names each slot's shard.  The first version places slots by
size, largest first, on the shard with the fewest bytes; a rebalance edits the
newest version, moving only as many slots as evenness needs.  Versions are
written side by side, so any earlier layout stays readable.

DataFrame functions only; the map, bounded by ``n_slots``, is the only thing the
driver holds.  The law is ``bytes``: shards have nearly equal bytes.

Defined results: a null text has 0 bytes, the empty text too; a null id is
hashed like any value; rows repeated whole share a slot unless together they
hold a thousandth of a shard, then each goes to a slot of its own; equal texts under
different ids spread over slots; an empty table gives an empty result and a map
that deals slots out evenly; input columns named like an added one are replaced.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh_names

MAP_SCHEMA = "version int, virtual_slot int, shard int, slot_bytes long"


def record_size(text_col: str, overhead: int = 16) -> Column:
    """UTF-8 bytes of the text (null: none) plus the record's own overhead."""
    return (F.coalesce(F.octet_length(text_col), F.lit(0)) + overhead).cast("long")


def record_key(id_col: str, text_col: str) -> Column:
    """Hash of a record's id and its text's checksum."""
    return F.xxhash64(F.col(id_col), text_crc(text_col))


def text_crc(text_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))


def virtual_slot(n_slots: int, key: str, row: str, heavy: str) -> Column:
    """Slot of a record by its key; of one that is repeated very often by its key and row."""
    return F.pmod(F.when(F.col(heavy).isNull(), F.col(key)).otherwise(F.xxhash64(key, row)), F.lit(n_slots)).cast("int")


def heavy_keys(records: DataFrame, n_shards: int, scratch: Scratch) -> DataFrame:
    """(key, heavy): keys whose repeated rows hold more than a thousandth of a shard's bytes.

    They are fewer than 1,000 times the shards, so their broadcast is bounded.
    """
    total = records.agg(F.sum("size")).first()[0] or 0
    keys = records.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("b")).filter((F.col("n") > 1) & (F.col("b") * n_shards * 1000 > total))
    return F.broadcast(scratch.write(keys.select("key", F.lit(True).alias("heavy")), "heavy", keep=True))


def slot_bytes(records: DataFrame, n_slots: int) -> dict[int, int]:
    """Bytes per virtual slot of (virtual_slot, size) rows: at most ``n_slots`` numbers."""
    got = records.groupBy("virtual_slot").agg(F.sum("size").alias("b")).collect()
    out = dict.fromkeys(range(n_slots), 0)
    out.update((r["virtual_slot"], r["b"]) for r in got)
    return out


def first_map(sizes: dict[int, int], n_shards: int) -> dict[int, int]:
    """Slots by size, largest first, each to the shard with the fewest bytes (ties: slots, shard)."""
    heap = [(0, 0, s) for s in range(n_shards)]
    out = {}
    for slot in sorted(sizes, key=lambda s: (-sizes[s], s)):
        used, n, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (used + sizes[slot], n + 1, shard))
    return out


def edited_map(old: dict[int, int], sizes: dict[int, int], n_shards: int, tolerance: float = 0.02) -> dict[int, int]:
    """The old map with slots moved until every shard has at most ``1 + tolerance`` of the mean.

    Slots of shards that no longer exist go first; then slots leave the fullest
    shard for the emptiest, the largest one that brings the two nearer.  All
    other slots stay where they are.
    """
    out = dict(old)
    load = dict.fromkeys(range(n_shards), 0)
    slots: dict[int, list[int]] = {s: [] for s in range(n_shards)}
    homeless = []
    for slot in sorted(sizes, key=lambda s: (-sizes[s], s)):
        shard = out.get(slot, -1)
        if 0 <= shard < n_shards:
            slots[shard].append(slot)
            load[shard] += sizes[slot]
        else:
            homeless.append(slot)
    for slot in homeless:
        shard = min(load, key=lambda s: (load[s], len(slots[s]), s))
        out[slot] = shard
        slots[shard].append(slot)
        load[shard] += sizes[slot]
    mean = sum(load.values()) / max(1, n_shards)
    for _ in range(len(sizes)):
        full, free = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
        if load[full] <= mean * (1 + tolerance) and load[free] >= mean * (1 - tolerance):
            break
        fit = [s for s in slots[full] if 0 < sizes[s] < load[full] - load[free]]
        if not fit:
            break
        gap = (load[full] - load[free]) / 2
        slot = min(fit, key=lambda s: (abs(sizes[s] - gap), s))
        slots[full].remove(slot)
        slots[free].append(slot)
        out[slot] = free
        load[full] -= sizes[slot]
        load[free] += sizes[slot]
    return out


def write_map(spark: SparkSession, path: str, version: int, slot_map: dict[int, int], sizes: dict[int, int]) -> None:
    """Store one version of the map under ``path`` (earlier versions stay)."""
    map_rows(spark, version, slot_map, sizes).write.parquet(f"{path}/map-{version:06d}")


def map_rows(spark: SparkSession, version: int, slot_map: dict[int, int], sizes: dict[int, int]) -> DataFrame:
    """One version of the map as rows, made from one JSON text."""
    text = json.dumps([[s, slot_map[s], int(sizes.get(s, 0))] for s in sorted(slot_map)])
    rows = spark.range(0, 1, 1, 1).select(F.explode(F.from_json(F.lit(text), "array<array<bigint>>")).alias("r"))
    return rows.select(F.lit(version).alias("version"), F.col("r")[0].cast("int").alias("virtual_slot"), F.col("r")[1].cast("int").alias("shard"), F.col("r")[2].alias("slot_bytes"))


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/map-{version:06d}")


def rebalance(spark: SparkSession, path: str, version: int, sizes: dict[int, int], n_shards: int,
              tolerance: float = 0.02) -> int:
    """Write the version after ``version``, edited for the present sizes; returns its number."""
    old = {r["virtual_slot"]: r["shard"] for r in read_map(spark, path, version).collect()}
    write_map(spark, path, version + 1, edited_map(old, sizes, n_shards, tolerance), sizes)
    return version + 1


def records_of(docs: DataFrame, scratch: Scratch, n_slots: int, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Narrow table (id, size, crc, virtual_slot), written once for the sizes and the placement."""
    rows = scratch.write(docs.select(F.col(id_col).alias("id"), record_size(text_col).alias("size"), text_crc(text_col).alias("crc"),
                                     record_key(id_col, text_col).alias("key"), F.monotonically_increasing_id().alias("row")), "rows")
    heavy = heavy_keys(rows, n_shards, scratch)
    slotted = rows.join(heavy, "key", "left").select("id", "size", "crc", virtual_slot(n_slots, "key", "row", "heavy").alias("virtual_slot"))
    return scratch.write(slotted, "records")


def shard_records(spark: SparkSession, docs: DataFrame, n_shards: int = 40, n_slots: int = 16384,
                  map_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, virtual_slot, shard, slot, map_version.  A written table.

    ``slot`` counts 0, 1, 2, ... within the shard: the rows of the shard's
    earlier virtual slots, then the order by id in the row's own, so that no
    task sees more than one virtual slot.  The map is stored under ``map_path``
    (the shared scratch folder if none is given) as version 1.
    """
    from ..session import scratch_path

    with Scratch(spark) as scratch:
        rec = records_of(docs, scratch, n_slots, n_shards, id_col, text_col)
        sizes = slot_bytes(rec, n_slots)
        path = map_path or scratch_path(spark, "llm-slot-map")
        if not map_path:
            scratch.paths.append(path)
        write_map(spark, path, 1, first_map(sizes, n_shards), sizes)
        layout = read_map(spark, path, 1)
        counts = rec.groupBy("virtual_slot").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
        places = layout.join(counts, "virtual_slot").select("version", "virtual_slot", "shard", F.coalesce(before, F.lit(0)).alias("first"))
        places = scratch.write(places, "places")
        own = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("id", "crc", "size"))
        # ``places`` has at most n_slots rows.
        out = rec.withColumn("own", own).join(F.broadcast(places), "virtual_slot").select(
            F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "virtual_slot", "shard",
            (F.col("first") + F.col("own") - 1).cast("long").alias("slot"), F.col("version").alias("map_version"))
        return scratch.write(out, "sharded", keep=True)


def add_shard(spark: SparkSession, docs: DataFrame, n_shards: int = 40, n_slots: int = 16384,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with columns virtual_slot and shard (first map of these documents).

    The rows' numbers, which part rows repeated very often, come from the same scan
    of ``docs`` for the sizes and for the result.
    """
    key, row, heavy_key, heavy = fresh_names(docs, "__key", "__row", "__heavy_key", "__heavy")
    plain = docs.drop("virtual_slot", "shard").withColumns({key: record_key(id_col, text_col), row: F.monotonically_increasing_id()})
    with Scratch(spark) as scratch:
        rows = scratch.write(plain.select(F.col(key).alias("key"), F.col(row).alias("row"), record_size(text_col).alias("size")), "rows")
        often = heavy_keys(rows, n_shards, scratch)
        sizes = slot_bytes(rows.join(often, "key", "left").select("size", virtual_slot(n_slots, "key", "row", "heavy").alias("virtual_slot")), n_slots)
    layout = map_rows(spark, 1, first_map(sizes, n_shards), sizes).select("virtual_slot", "shard")
    often = often.select(F.col("key").alias(heavy_key), F.col("heavy").alias(heavy))
    placed = plain.join(F.broadcast(often), F.col(key) == F.col(heavy_key), "left").withColumn("virtual_slot", virtual_slot(n_slots, key, row, heavy))
    return placed.join(F.broadcast(layout), "virtual_slot").select(*[c for c in docs.columns if c not in ("virtual_slot", "shard")], "virtual_slot", "shard")
