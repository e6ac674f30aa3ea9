"""Shared plumbing: scratch tables, distributed ranks, literal tables, storage."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinlake.sources.scratch import materialise, new_folder  # noqa: F401

#: Code points that regular expressions of the tokenizers treat as white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def long_array(values: Sequence[int]) -> Column:
    """A literal array<bigint> that costs one plan node, not one per value."""
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<bigint>")


def global_rank(df: DataFrame, order: Sequence[str], name: str = "rank", out: str = "pos") -> DataFrame:
    """Add `out`, the gapless 0-based rank by `order` (ascending, nulls first).

    One range shuffle and a sort inside partitions; a partition's rows get consecutive ids, the
    partitions' counts (one number each) go to the driver and come back as start offsets. Hot values are
    split as long as `order` ends with a column that tells rows apart. Equal rows get any order, fixed
    by the written table. An empty table gives an empty result.
    """
    spark = df.sparkSession
    ordered = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    table = materialise(ordered.withColumn("_mid", F.monotonically_increasing_id()), name)
    part = F.shiftright("_mid", 33)
    counts = {r["p"]: r["n"] for r in table.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = [0] * (max(counts, default=0) + 1), 0
    for p in sorted(counts):
        starts[p], total = total, total + counts[p]
    pos = F.element_at(long_array(starts), (part + 1).cast("int")) + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return table.withColumn(out, pos).drop("_mid")


def file_position() -> Column:
    """A row's place in a Parquet table that Spark wrote, its files read in turn: ascending, not gapless."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("bigint")
    return F.shiftleft(part, 40) + F.col("_metadata.row_index")


def text_array(values: Sequence[str]) -> Column:
    """A literal array<string> that costs one plan node."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


def bucket_of(value: Column, splits: Sequence[int] | Sequence[str]) -> Column:
    """How many of the ascending `splits` are <= value, by binary search inside the JVM; null counts as below all."""
    if not splits:
        return F.lit(0)
    steps, table = [], (text_array if isinstance(splits[0], str) else long_array)(splits)
    step = 1 << (len(splits).bit_length() - 1)
    while step:
        steps.append(step)
        step >>= 1
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when((at + s <= len(splits)) & (F.element_at(table, F.least(at + s, F.lit(len(splits)))) <= value), at + s).otherwise(at),
    )


def text_quantiles(df: DataFrame, column: str, parts: int) -> list[str]:
    """The distinct values of a string column, in byte order, at which 1/parts, 2/parts, ... of the non-null rows are reached.
    Distinct values are counted and sorted by ranges; the ranges' sums (a number each) and the quantiles reach the driver."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    ranges = counts.repartitionByRange(shuffle_partitions(df.sparkSession), "v").withColumn("p", F.spark_partition_id())
    table = materialise(ranges, "distinct-values")
    sums = {r["p"]: r["n"] for r in table.groupBy("p").agg(F.sum("n").alias("n")).collect()}
    starts, total = [0] * (max(sums, default=0) + 1), 0
    for p in sorted(sums):
        starts[p], total = total, total + sums[p]
    if not total:
        return []
    within = F.sum("n").over(Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reached = table.select("v", (within + F.element_at(long_array(starts), F.col("p") + 1)).alias("upto"))
    found = reached.agg(*[F.min(F.when(F.col("upto") * parts >= total * i, F.col("v"))).alias(f"q{i}") for i in range(1, parts)]).first()
    return sorted(set(found), key=str.encode)


def storage(uri: str):
    """(file system, path) of pyarrow for a folder of the cluster: file, hdfs, s3, gs, or a plain local path."""
    import pyarrow.fs as pafs

    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def text_hash(docs: DataFrame) -> Column:
    """A bigint hash of `docs`' text; null counts as empty. Rows are told apart by doc_id and it."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
