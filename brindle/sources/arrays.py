"""JSON arrays of any size, read by many tasks and written by many tasks.

The text of an array is read in fragments that end in a closing brace, which Spark's text source splits anywhere. Whether
a brace stands in a string, and how deep, follows from what comes before it; each split is summed up for both cases and
the sums are put together over all splits, so that no task reads more than its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.sources import scratch

_SPLIT = ["file", "block"]


def _fragments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text between closing braces: place, parity of its quotes, and change of depth if it begins outside or inside a string."""
    raw = spark.read.option("lineSep", "}").text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("id"))
    quoted = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')
    count = lambda text, kind: F.length(text) - F.length(F.translate(text, kind, ""))

    def change(parts: Column, first: int) -> Column:
        """Opened less closed outside strings, when the parts with that remainder are outside; the brace at the end counts."""
        outside = F.array_join(F.filter(parts, lambda _, i: i % 2 == first), "")
        ends_outside = (F.size(parts) + 1 + first) % 2 == 0
        return (count(outside, "{[") - count(outside, "}]") - ends_outside.cast("int")).cast("long")

    # The array of one binds the split text, which is then cut once.
    seen = lambda parts: F.struct(((F.size(parts) - 1) % 2).cast("long").alias("odd"), change(parts, 0).alias("out"), change(parts, 1).alias("inn"))
    return raw.withColumn("sums", F.transform(F.array(quoted), seen)[0]).select("value", *_SPLIT, "size", "id", "sums.*")


def elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The objects of one or more JSON arrays as text, one a row, with line breaks between tokens made spaces.

    ``path`` is a file or a folder; the parts of a folder may be arrays each, or one array cut anywhere between objects, in
    the order of their names. Elements that are numbers, strings or literals are passed over; arrays inside are not split.
    Encoding is UTF-8. Splits are as large as ``spark.sql.files.maxPartitionBytes`` says, and each is one task's work;
    rows that cross a split's edge are put together from at most one piece a split."""
    found = _fragments(spark, path)
    inside = Window.partitionBy(*_SPLIT).orderBy("id")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    flipped = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2
    found = found.withColumn("flipped", flipped)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("d0", F.sum(F.when(F.col("flipped") == 0, F.col("out")).otherwise(F.col("inn"))).over(upto))
    found = found.withColumn("d1", F.sum(F.when(F.col("flipped") == 1, F.col("out")).otherwise(F.col("inn"))).over(upto))

    # One row a split: what it does to either state. Text after a file's last brace was counted as if it ended in one.
    sums = found.groupBy(*_SPLIT).agg((F.sum("odd") % 2).alias("odd"), F.max_by("d0", "id").alias("d0"), F.max_by("d1", "id").alias("d1"), F.sum(F.octet_length("value") + 1).alias("octets"), F.first("size").alias("size"))
    whole = Window.partitionBy("file")
    open_end = (F.sum("octets").over(whole) - F.col("size")).isin(1, -2) & (F.col("block") == F.max("block").over(whole))  # -2: less a byte order mark
    sums = sums.withColumn("spare", open_end.cast("long"))
    order = Window.orderBy(*_SPLIT)  # a row a split, not a row of the data
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("inside", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    sums = sums.withColumn("net", F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1")) + F.col("spare"))
    starts = sums.select(*_SPLIT, "inside", F.coalesce(F.sum("net").over(earlier), F.lit(0)).alias("depth"))

    placed = found.join(starts, _SPLIT)
    depth = F.col("depth") + F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1"))
    outside = (F.col("inside") + F.col("flipped") + F.col("odd")) % 2 == 0
    placed = placed.withColumn("closes", ((depth == 1) & outside).cast("long"))
    placed = placed.withColumn("piece", F.coalesce(F.sum("closes").over(before), F.lit(0)))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", F.concat("value", F.lit("}")).alias("value")))), lambda x: x["value"]), "")
    pieces = placed.groupBy(*_SPLIT, "piece").agg(joined.alias("value"), F.max("closes").alias("closes"))

    # Only a split's first and last piece may belong to its neighbours' rows.
    edge = (F.col("piece") == 0) | (F.col("closes") == 0)
    along = Window.orderBy(*_SPLIT, "piece").rowsBetween(Window.unboundedPreceding, -1)
    edges = pieces.where(edge).withColumn("row", F.coalesce(F.sum("closes").over(along), F.lit(0)))
    part = F.struct(*_SPLIT, "piece", "value")
    stitched = edges.groupBy("row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["value"]), "").alias("value"), F.max("closes").alias("closes"))
    rows = pieces.where(~edge).select("value").unionByName(stitched.where("closes = 1").select("value"))
    # A row's text begins behind the last one: with commas, brackets, and elements that are no objects.
    text = F.regexp_replace("value", "^[\\s,\\[\\]\\x{FEFF}]*+", "")
    plain = F.when(text.startswith("{"), text).otherwise(F.regexp_replace(text, r'^(?:[^{"]++|"(?:[^"\\]++|\\.)*+")*+', ""))
    return rows.select(F.translate(plain, "\r\n", "  ").alias("value"))


def write_array(df: DataFrame, path: str) -> None:
    """Write a frame as one JSON array over many files, which read in the order of their names are the array; ``[]`` if empty.

    Rows keep the order of the frame's partitions. The frame is stored once with its places, so that a task that runs
    again writes the same lines."""
    spark = df.sparkSession
    folder = scratch.folder(spark)
    # to_json of a struct leaves gaps out unless told otherwise.
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"), F.monotonically_increasing_id().alias("place")).write.parquet(folder)
    stored = spark.read.schema("value string, place long").parquet(folder)
    low, high = stored.agg(F.min("place"), F.max("place")).first()
    if low is None:
        spark.createDataFrame([("[]",)], "value string").coalesce(1).write.text(path)
        return
    sign = F.when(F.col("place") == low, "[").otherwise(",")
    end = F.when(F.col("place") == high, "]").otherwise("")
    stored.repartitionByRange("place").sortWithinPartitions("place").select(F.concat(sign, "value", end).alias("value")).write.text(path)
