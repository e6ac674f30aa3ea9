"""Mixing sources to target weights by proportionate-fair scheduling (Baruah, Cohen, Plaxton, Varvel 1996).

A source's documents form blocks. In the fluid schedule each source that still has blocks gets its weight's part of
every slot; when one ends, the others share its part by their weights. The fluid schedule serves block k of a source
from one moment to another, which a closed formula tells; the block is released at the last whole slot before
the one and due by the first whole slot after the other. Of the released blocks the one with the earliest deadline takes
the slot. Every window holds its block's fluid service, so that all deadlines are met and, after any number of slots, each
source is less than one block from its fluid share, which is the target weight's as long as no source has ended.
Weights are taken as they are (doubles are whole numbers over a power of two; all arithmetic is exact), and every source
has windows of its own. Nothing is dropped or repeated.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlake.llm.common import documents, global_rank, materialise

#: Rows of a block. The schedule is made by one task that streams it out, some 400,000 slots a second in memory of one
#: entry a source: for 10^10 rows and more, take blocks of thousands.
BLOCK_ROWS = 64
#: Sources whose first positions are broadcast; beyond, the engine joins by shuffle and splits skewed keys.
BROADCAST_SOURCES = 100_000


def whole_weights(weights: Sequence[float]) -> list[int]:
    """Positive whole numbers in exactly the proportions of `weights`."""
    if any(not (w > 0 and math.isfinite(w)) for w in weights):
        raise ValueError("weights must be positive and finite")
    ratios = [float(w).as_integer_ratio() for w in weights]
    scale = max((d for _, d in ratios), default=1)  # powers of two
    out = [n * (scale // d) for n, d in ratios]
    common = math.gcd(*out)
    return [w // common for w in out] if common > 1 else out


class Fluid:
    """The fluid schedule of sources with `blocks` blocks and whole `weights`."""

    def __init__(self, blocks: Sequence[int], weights: Sequence[int]):
        self.blocks, self.weights = blocks, weights
        # Sources by the virtual time blocks / weight at which they end; as whole numbers, by a common factor.
        order = sorted(range(len(blocks)), key=_Ratio.of(blocks, weights))
        self.ends = [_Ratio(blocks[s], weights[s]) for s in order]
        self.done, self.active = [0], [sum(weights)]
        for s in order:
            self.done.append(self.done[-1] + blocks[s])
            self.active.append(self.active[-1] - weights[s])

    def at(self, s: int, k: int) -> tuple[int, int]:
        """The moment at which block k of source s begins to be served (the end of block k - 1), as numerator and denominator:
        the slots that all sources have had when s has had k."""
        n = bisect_right(self.ends, _Ratio(k, self.weights[s]))
        return self.done[n] * self.weights[s] + k * self.active[n], self.weights[s]


class _Ratio:
    """a / b with exact comparisons, first by doubles where these are far enough apart."""

    __slots__ = ("a", "b", "x")

    def __init__(self, a: int, b: int):
        self.a, self.b, self.x = a, b, a / b

    def __lt__(self, other: _Ratio) -> bool:
        if abs(self.x - other.x) > 1e-12 * (self.x + other.x):
            return self.x < other.x
        return self.a * other.b < other.a * self.b

    @staticmethod
    def of(blocks: Sequence[int], weights: Sequence[int]):
        return lambda s: _Ratio(blocks[s], weights[s])


def schedule(blocks: Sequence[int], weights: Sequence[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(source, block, release, deadline, slot) in the order of slots, earliest deadline first; ties go to the greater weight,
    then to the first source. Sources are numbers; weights are whole."""
    fluid = Fluid(blocks, weights)
    waiting: list[tuple[int, int, int]] = [(0, s, 0) for s in range(len(blocks)) if blocks[s]]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int, int]] = []
    for slot in range(sum(blocks)):
        while waiting and waiting[0][0] <= slot:
            release, s, k = heapq.heappop(waiting)
            n, d = fluid.at(s, k + 1)
            heapq.heappush(ready, (-(-n // d), -weights[s], s, k, release))
        deadline, _, s, k, release = heapq.heappop(ready)
        yield s, k, release, deadline, slot
        if k + 1 < blocks[s]:
            n, d = fluid.at(s, k + 1)
            heapq.heappush(waiting, (n // d, s, k + 1))


_SCHEDULE = "key string, weight double, block bigint, release bigint, deadline bigint, slot bigint, before bigint"


def slots(sources: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The schedule of `sources` (key, n, weight), a row a block: key, its share as `weight`, block, release, deadline, slot, and
    `before`, the rows of all blocks before it. One task reads a row a source and streams the schedule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        counts = [n for _, n, _ in rows]
        blocks, weights = [-(-n // block_rows) for n in counts], whole_weights([w for _, _, w in rows])
        total, before, out = sum(weights), 0, []
        kinds = [pa.string(), pa.float64(), *[pa.int64()] * 5]
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        names = [c.split()[0] for c in _SCHEDULE.split(", ")]
        for s, k, release, deadline, slot in schedule(blocks, weights):
            out.append((rows[s][0], weights[s] / total, k, release, deadline, slot, before))
            before += min(block_rows, counts[s] - k * block_rows)
            if len(out) == 16384:
                yield made()
                out = []
        if out:
            yield made()

    return sources.select("key", "n", "weight").repartition(1).mapInArrow(run, _SCHEDULE)


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, order: str = "doc_id") -> DataFrame:
    """doc_id, source, weight, block, release, deadline, slot, place and position for each row of `docs`.

    weights: target weights by source; by default the square root of each source's rows, which raises small sources.
    Sources without a weight take the least of those given; `weight` is the share of all sources' sum. Windows and slots
    count from the start of the whole schedule; place is the row's in its block, by `order`; position is gapless from 0
    over the mixture. Rows without a source are a source of their own, named by None. Repeated rows are placed one
    by one; an empty table gives no rows.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint"), key.alias("key"), F.col(order).alias("_order"), F.xxhash64("doc_id", "text").alias("_tie"))
    ranked = global_rank(rows, ["key", "_order", "_tie"], "mixed")
    sources = ranked.groupBy("key").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    if weights is None:
        sources = sources.withColumn("weight", F.sqrt(F.col("n").cast("double")))
    else:
        given = [("" if s is None else f"={s}", float(w)) for s, w in weights.items()]
        whole_weights([w for _, w in given])
        table = spark.createDataFrame(given, "key string, weight double")
        sources = sources.join(F.broadcast(table), "key", "left").na.fill(min((w for _, w in given), default=1.0), ["weight"])
    sources = materialise(sources, "sources")
    placed = materialise(slots(sources, block_rows), "slots")
    starts = sources.select("key", "first")
    starts = F.broadcast(starts) if starts.count() <= BROADCAST_SOURCES else starts
    rank = F.col("pos") - F.col("first")
    out = ranked.join(starts, "key").withColumn("block", F.floor(rank / F.lit(block_rows))).withColumn("place", rank % block_rows)
    out = out.join(placed, ["key", "block"])
    source = F.when(F.col("key") != "", F.expr("substring(key, 2)"))
    return out.select("doc_id", source.alias("source"), "weight", "block", "release", "deadline", "slot", "place", (F.col("before") + F.col("place")).alias("position"))


def mixed(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows of `docs`, with its columns, laid out in the mixture's order: partitions are ranges of position, sorted
    inside, so that a reader of the written files in turn meets the target weights. Rows that share a doc_id follow
    each other at the least of their positions; rows with a null doc_id come last, by their texts' hashes."""
    at = mix(docs, weights, block_rows).groupBy("doc_id").agg(F.min("position").alias("_mixed_at"))
    at = materialise(at.filter("doc_id IS NOT NULL").withColumnRenamed("doc_id", "_mixed_id"), "positions")
    joined = docs.join(at, docs["doc_id"].cast("bigint") == at["_mixed_id"], "left").withColumn("_mixed_tie", F.xxhash64(docs["text"]))
    joined = joined.withColumn("_mixed_at", F.coalesce("_mixed_at", F.lit(1 << 62)))
    return joined.repartitionByRange("_mixed_at", "_mixed_tie").sortWithinPartitions("_mixed_at", "_mixed_tie").drop("_mixed_at", "_mixed_tie", "_mixed_id")


def op4_pfair(spark, sf_dir: str) -> DataFrame:
    """Every document's place in the mixture of sources at the square roots of their sizes; see `mix`."""
    return mix(documents(spark, sf_dir))
