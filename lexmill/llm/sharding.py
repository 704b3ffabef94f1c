"""Shards of nearly equal bytes: sampled splitters, ranges, and places counted in them.

Records are ordered by (MD5 of the text, id), so equal texts lie together. A
sample in proportion to size gives quantile boundaries; records are partitioned
by these ranges, overfull ones subdivided; running sums inside of ranges, with
what the ranges before them hold, give each record its place among all bytes.
Shards are intervals of these places. The boundaries are drawn, the places exact:
another sample gives the same shards.

Records over 1/HEAVY of a shard, HEAVY a shard at most, are dealt first, the
largest to the emptiest shard; intervals fill up what they leave. So a shard
differs from the even share by 1/HEAVY of it, more only if records are larger
than a share. One law holds: ``bytes``.

Cases: a null text has size 16 and checksum 0; null ids come first and equal
rows get places of their own; an empty table gives no rows; other columns are
not read by ``assign`` and kept by ``write_shards``, which replaces columns
named shard or slot. Columns only.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm import ranges
from lexmill.llm.common import checkpointed, discard

#: Bytes that a record takes besides its text.
RECORD = 16
HEAVY = 32


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + RECORD


def _heavy_places(heavy: DataFrame, shards: int) -> DataFrame:
    """_row, shard, slot, size: the largest record goes to the emptiest shard, again and again."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("minus"), "h", "id", "_row")))
    empty = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array_repeat(F.lit(0).cast("long"), shards).alias("counts"), F.expr("cast(array() as array<struct<_row: bigint, shard: int, slot: bigint, size: bigint>>)").alias("places"))

    def put(state: Column, record: Column) -> Column:
        to = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        add = lambda values, more: F.transform(values, lambda v, i: F.when(i == to, v + more).otherwise(v))
        place = F.struct(record["_row"].alias("_row"), to.alias("shard"), F.get(state["counts"], to).alias("slot"), (-record["minus"]).alias("size"))
        return F.struct(add(state["loads"], -record["minus"]).alias("loads"), add(state["counts"], F.lit(1)).alias("counts"), F.concat(state["places"], F.array(place)).alias("places"))

    return heavy.agg(F.aggregate(listed, empty, put)["places"].alias("places")).select(F.inline("places"))


def _edges(loads: list[int], rest: int) -> list[int]:
    """Where the intervals of all shards but the first begin, so that loads and intervals come to one level where they can."""
    below = list(accumulate(sorted(loads)))
    k, water = max((k, rest + b) for k, (b, load) in enumerate(zip(below, sorted(loads), strict=True), 1) if rest + b >= k * load)
    return [x // k for x in accumulate(max(0, water - k * load) for load in loads)][:-1]


def assign(docs: DataFrame, shards: int, text: str = "text", record_id: str = "doc_id", each: int = ranges.EACH) -> DataFrame:
    """id, size, text_crc32, shard, slot, _row: the place of each record; ``_row`` is that of ``ranges.numbered`` if ``docs`` has it."""
    columns = [F.col(record_id).alias("id"), size_of(F.col(text)).alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("h")]
    narrow = docs.select(*columns, *[c for c in docs.columns if c == "_row"])
    rows = checkpointed(narrow, "records") if "_row" in docs.columns else ranges.numbered(narrow, "records")
    total = rows.agg(F.sum("size")).first()[0] or 0
    is_heavy = F.col("size") * (HEAVY * shards) > total
    heavy = checkpointed(_heavy_places(rows.where(is_heavy), shards), "heavy")
    loads, counts = [0] * shards, [0] * shards
    for shard, load, n in heavy.groupBy("shard").agg(F.sum("size"), F.count(F.lit(1))).collect():
        loads[shard], counts[shard] = load, n
    rest = total - sum(loads)
    order = ["h", "id", "_row"]
    light = ranges.ranged(rows.where(~is_heavy), F.struct(*order), F.col("size"), each)
    light = ranges.running(light, [], "_range", order, {"upto": (F.col("size"), "sum"), "n": (F.lit(1), "sum")})
    edges = _edges(loads, rest)
    middle = F.col("upto") * 2 - F.col("size")
    shard = ranges.position(F.array(*[F.lit(2 * e).cast("long") for e in edges]), len(edges), middle) if edges else F.lit(0)
    light = checkpointed(light.select("id", "size", "text_crc32", "_row", "n", shard.cast("int").alias("shard")), "places")
    first = light.groupBy("shard").agg(F.min("n").alias("first"))
    used = F.get(F.array(*[F.lit(n).cast("long") for n in counts]), F.col("shard"))
    columns = ["id", "size", "text_crc32", "shard", "slot", "_row"]
    placed = light.join(F.broadcast(first), "shard").withColumn("slot", F.col("n") - F.col("first") + used).select(*columns)
    large = rows.where(is_heavy).join(F.broadcast(heavy.drop("size")), "_row").select(*columns)
    return placed.unionByName(large)


def write_shards(docs: DataFrame, folder: str, shards: int, text: str = "text", record_id: str = "doc_id") -> None:
    """All columns of ``docs`` as Parquet in ``folder``/shard=N, by slot; a shard of many bytes in several files, each of one run of slots."""
    staged = ranges.numbered(docs.drop("shard", "slot"), "staged")
    places = assign(staged, shards, text, record_id).select("_row", "shard", "slot", F.floor(F.col("slot") / ranges.ROWS_EACH).alias("_file"))
    rows = staged.join(places, "_row").drop("_row").repartition("shard", "_file").sortWithinPartitions("shard", "slot")
    rows.drop("_file").write.partitionBy("shard").parquet(folder)
    discard(staged)
