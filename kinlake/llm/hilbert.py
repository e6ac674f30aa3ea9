"""Sharding along a Hilbert curve.

Metadata dimensions are quantised into 2^bits cells each, at quantiles of the data; a cell's place on the curve
comes from Hamilton's state machine (rotation and reflection per level), whose table this module derives from
the Gray code. Rows are ranked along the curve and cut into runs of equal counts, so that a shard covers a
compact box of every dimension and readers skip shards by its bounds. All of it runs on JVM operators.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlake.llm.common import bucket_of, documents, global_rank, long_array, materialise, text_quantiles

BITS = 5
SHARDS = 24


@lru_cache
def machine(dims: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(digit, next state) by state * 2^dims + octant; state = direction * 2^dims + entry point."""
    size = 1 << dims
    rot = lambda x, k: ((x << (k % dims)) | (x >> (dims - k % dims))) & (size - 1)
    gray = lambda i: i ^ (i >> 1)
    inverse = {gray(i): i for i in range(size)}
    entry = lambda i: 0 if i == 0 else gray(2 * ((i - 1) // 2))
    ones = lambda i: ((i ^ (i + 1)).bit_length() - 1) % dims  # trailing ones

    def turn(i: int) -> int:
        return 0 if i == 0 else ones(i - 1) if i % 2 == 0 else ones(i)

    digits, nexts = [], []
    for direction in range(dims):
        for e in range(size):
            for octant in range(size):
                w = inverse[rot(octant ^ e, dims - (direction + 1) % dims)]
                e2, d2 = e ^ rot(entry(w), direction + 1), (direction + turn(w) + 1) % dims
                digits.append(w)
                nexts.append(d2 * size + e2)
    return tuple(digits), tuple(nexts)


def hilbert_index(point: str, dims: int, bits: int = BITS) -> Column:
    """The curve index (bigint) of an array<bigint> column of `dims` coordinates in [0, 2^bits)."""
    digits, nexts = (long_array(x) for x in machine(dims))

    def step(acc: Column, level: Column) -> Column:
        octant = sum(((F.get(point, F.lit(d)).bitwiseAND(level) > 0).cast("bigint") * F.lit(1 << d) for d in range(dims)), F.lit(0))
        at = (acc["s"] * F.lit(1 << dims) + octant + 1).cast("int")
        return F.struct((acc["h"] * F.lit(1 << dims) + F.element_at(digits, at)).alias("h"), F.element_at(nexts, at).alias("s"))

    levels, zero = long_array([1 << b for b in reversed(range(bits))]), F.lit(0).cast("bigint")
    return F.aggregate(levels, F.struct(zero.alias("h"), zero.alias("s")), step, lambda acc: acc["h"])


def quantised(df: DataFrame, dims: Sequence[str], bits: int = BITS) -> list[Column]:
    """Each dimension's cell: how many of 2^bits - 1 quantiles are at most the value, strings in byte order; nulls are in cell
    0. Numbers' quantiles are mergeable sketches, strings' come from counts of distinct values; a few values a dimension
    reach the driver."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    texts = [d for d in dims if isinstance(kinds[d], T.StringType)]
    n, found = 1 << bits, {d: text_quantiles(df, d, 1 << bits) for d in texts}
    numbers = [d for d in dims if d not in texts]
    if numbers:
        r = df.agg(*[F.percentile_approx(F.col(d).cast("bigint"), [i / n for i in range(1, n)], 10_000).alias(d) for d in numbers]).first()
        found |= {d: sorted(set(r[d] or [])) for d in numbers}
    return [F.coalesce(bucket_of(F.col(d) if d in texts else F.col(d).cast("bigint"), found[d]), F.lit(0)) for d in dims]


def shard(df: DataFrame, dims: Sequence[str], tie: Sequence[str], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Add hilbert, shard and slot (gapless from 0 in each shard) to `df`; shards' counts differ by one at most.

    `tie` orders rows of one cell; it should tell rows apart, so that a cell with a third of all rows is cut like any
    other. Repeated rows lie side by side. An empty table gives no rows. Columns of `df` that have one of the three names
    come back with `_input` added to theirs.
    """
    taken = {c: f"{c}_input" for c in df.columns if c in ("hilbert", "shard", "slot")}
    df, dims, tie = df.withColumnsRenamed(taken), [taken.get(c, c) for c in dims], [taken.get(c, c) for c in tie]
    cells = F.array(*[c.cast("bigint") for c in quantised(df, dims, bits)])
    indexed = df.withColumn("_cells", cells).withColumn("hilbert", hilbert_index("_cells", len(dims), bits)).drop("_cells")
    ranked = global_rank(indexed, ["hilbert", *tie], "hilbert", "_place")
    n = ranked.count()
    # Whole numbers throughout: floor(place * shards / n), and the first place of a shard is ceil(shard * n / shards).
    out = ranked.withColumn("shard", F.expr(f"cast((_place * {shards}) div {max(n, 1)} as int)"))
    first = F.expr(f"(cast(shard as bigint) * {n} + {shards - 1}) div {shards}")
    return out.withColumn("slot", F.col("_place") - first).drop("_place")


def bounds(sharded: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Per shard: rows, and min_ and max_ of each dimension: what a reader needs to skip shards. Shards without rows have none."""
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))])


def write(sharded: DataFrame, path: str) -> None:
    """Parquet, one folder per shard, rows along the curve."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op3_hilbert(spark, sf_dir: str) -> DataFrame:
    """Every document's shard along the curve of source, language and size; see `shard`."""
    text = F.coalesce("text", F.lit(""))
    docs = documents(spark, sf_dir).select(
        F.col("doc_id").cast("bigint"), (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), "lang", "source"
    )
    sharded = shard(materialise(docs, "sizes"), ["source", "lang", "size"], ["doc_id", "text_crc32"])
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
