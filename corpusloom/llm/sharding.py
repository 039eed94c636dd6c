"""Sharding through fixed virtual slots, with DataFrame functions only.

Records hash into a fixed number of virtual slots. The bytes of each slot are summed and a
slot-to-shard map is built once; rebalancing edits the map (moves a few slots) and bumps its
version, records keep their slots for ever. The map has as many rows as there are slots,
whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import expanded, materialize, new_path

SLOTS = 4096
#: Equal rows that share a slot; the next as many go to another.
PIECE = 64


def slot_of(*record: Column, slots: int = SLOTS) -> Column:
    """Virtual slot of a record: the first 12 bits or so of an MD5, evened over ``slots``."""
    name = F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("")) for c in record))
    return (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % slots).cast("int")


def assign(slot_bytes: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: (version, vslot, shard, bytes, rows), heaviest slot first, each
    to the lightest shard (the lowest number of equals).

    One fold over an array of ``SLOTS`` entries at most.
    """
    one = slot_bytes.groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("order"), "vslot", "bytes", "rows"))).alias("all"))
    start = F.struct(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.lit(0).cast("long")).alias("load"), F.expr("cast(array() as array<int>)").alias("shard"))

    def step(acc, x):
        at = F.array_position(acc["load"], F.array_min(acc["load"])).cast("int") - 1
        load = F.transform(acc["load"], lambda v, i: F.when(i == at, v + x["bytes"]).otherwise(v))
        return F.struct(load.alias("load"), F.concat(acc["shard"], F.array(at)).alias("shard"))

    folded = one.select("all", F.aggregate("all", start, step, lambda a: a["shard"]).alias("shard"))
    rows = folded.select(F.explode(F.arrays_zip("all", "shard")).alias("x"))
    return rows.select(F.lit(1).alias("version"), F.col("x.all.vslot").alias("vslot"), F.col("x.shard").alias("shard"), F.col("x.all.bytes").alias("bytes"), F.col("x.all.rows").alias("rows"))


def grow(slot_map: DataFrame, shards: int) -> DataFrame:
    """Next version of a map of ``shards`` shards: one shard more.

    Every shard gives up its lightest slots until it would fall below the new mean; the
    slots go to the new shard and no other slot moves.
    """
    mean = F.sum("bytes").over(Window.partitionBy()) / (shards + 1)
    own = Window.partitionBy("shard")
    given = F.sum("bytes").over(own.orderBy("bytes", "vslot"))
    moves = F.sum("bytes").over(own) - given >= mean
    return slot_map.select((F.col("version") + 1).alias("version"), "vslot", F.when(moves, F.lit(shards)).otherwise(F.col("shard")).alias("shard"), "bytes", "rows")


def store(slot_map: DataFrame, path: str) -> None:
    """Append a version of the map to the table at ``path``; older versions stay readable."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def shard(docs: DataFrame, *, doc_id="doc_id", text="text", shards=40, slots=SLOTS, map_path: str | None = None) -> DataFrame:
    """Put every document into a shard so that bytes are near equal.

    Returns doc_id, size (UTF-8 bytes of the text and 16), text_crc32, law ("bytes"), shard,
    slot (place in the shard, gapless from 0), grown_shard (null under this law), vslot (the
    virtual slot), next_shard (where the slot goes when there is one shard more). The map is
    stored at ``map_path`` (by default in the shared folder) in two versions: as it is used, and as
    :func:`grow` edits it. Null texts have no bytes and CRC 0, very long ones are a record of their
    size; null doc_ids and repeated rows are separate records; other columns are ignored; no rows
    give no rows.

    A record's slot comes from its doc_id, checksum and size, so null and repeated doc_ids
    spread; rows equal in all three are counted (on the map side too) and each ``PIECE`` of them
    has a slot of its own, so no slot is hot. Records are shuffled as (doc_id, size, checksum),
    never with their texts; places in a shard are a running count inside a slot on top of a
    prefix sum over the map.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    d = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    alike = materialize(d.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies")), "records")
    pieces = expanded(alike.withColumn("pieces", F.ceil(F.col("copies") / PIECE)), "pieces", "piece")
    n = F.least(F.lit(PIECE), F.col("copies") - F.col("piece") * PIECE)
    pieces = pieces.select("doc_id", "size", "text_crc32", "piece", n.alias("n"), slot_of(F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("piece"), slots=slots).alias("vslot"))
    path = map_path or new_path(docs.sparkSession, "slot-map")
    store(assign(pieces.groupBy("vslot").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows")), shards), path)
    maps = docs.sparkSession.read.schema("version int, vslot int, shard int, bytes long, rows long").parquet(path)
    now = maps.filter("version = 1")
    store(grow(now, shards), path)
    later = maps.sparkSession.read.schema(maps.schema).parquet(path).filter("version = 2").select("vslot", F.col("shard").alias("next_shard"))
    base = F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot")) - F.col("rows")
    bases = F.broadcast(now.select("vslot", "shard", base.alias("base")).join(F.broadcast(later), "vslot"))  # a row per slot, whatever the data
    order = Window.partitionBy("vslot").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size", "piece")
    inside = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    out = pieces.withColumn("inside", inside).join(bases, "vslot").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    slot = (F.col("base") + F.col("inside") + F.col("copy")).cast("long")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", "next_shard")
