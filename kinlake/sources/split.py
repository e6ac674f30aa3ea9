"""The task's three tables, found by name, tagged and normalised."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlake.functions import fuzzy
from kinlake.functions import text as T
from kinlake.sources import views


def find_file(spark: SparkSession, root: str, name: str) -> str:
    """The path of the file, or folder of part files, called `name` anywhere under `root`: the first in the order of paths. Raises
    FileNotFoundError without one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = set()
    while files.hasNext():
        parts = files.next().getPath().toString().split("/")
        if name in parts:
            found.add("/".join(parts[: parts.index(name) + 1]))
    if not found:
        raise FileNotFoundError(f"no {name} under {root}")
    return min(found)


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table as it is: all columns as strings, no row dropped, empty fields as ''."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("escape", "").csv(path)
    return raw.na.fill("")


def read_pruned(spark: SparkSession, path: str, columns: list[str], every: list[str]) -> DataFrame:
    """`columns` of a table whose header is `every`: the scan parses these alone, and lines with another number of fields are skipped."""
    schema = ", ".join(f"`{c}` string" for c in [*every, "_bad"])
    raw = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("escape", "").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)
    return raw.filter("_bad IS NULL").select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def read_candidates(spark: SparkSession, path: str, key: str = "source1_entity_id", items: str = "candidate_entity_ids") -> DataFrame:
    """Distinct (i, j) of a table of comma lists."""
    lists = views.read_tsv(spark, path, (key, items))
    return lists.select(F.col(key).alias("i"), F.explode(F.split(items, ",")).alias("j")).select("i", F.trim("j").alias("j")).filter("j <> ''").distinct()


def normalise(records: DataFrame, name: str = "business_name", address: str = "business_address", any_script: bool = False) -> DataFrame:
    """`records` with full and name (all words and the core), addr, nat and dom instead of the raw columns. With any_script, letters beyond
    Latin are written in plain ones first, in an Arrow pass."""
    raw, place = F.col(name), T.native_states(F.coalesce(F.col(address), F.lit("")))
    flags = T.name_flags(F.coalesce(F.col(name), F.lit("")))
    named, placed = (fuzzy.fold_scripts(raw), fuzzy.fold_scripts(place)) if any_script else (raw, place)
    out = records.withColumn("_f", flags).withColumn("_n", T.norm_name(named)).withColumn("_a", T.norm_address(placed)).drop(name, address)
    return out.select(*[c for c in out.columns if c not in ("_f", "_n", "_a")], F.col("_n.n_full").alias("full"), F.col("_n.n_core").alias("name"), F.col("_a").alias("addr"), "_f.nat", "_f.dom")


def load_split(spark: SparkSession, root: str, prefix: str, before: Callable[[DataFrame], DataFrame] | None = None, any_script: bool = False) -> DataFrame:
    """The tables <prefix>_source1.tsv to 3, wherever they are under `root`, as one: entity_id, country, src (0 anchors, 1 and 2 targets)
    and the normalised columns. `before` may change the raw rows (learn and apply dictionaries, say)."""
    out = None
    for n in (1, 2, 3):
        part = views.read_tsv(spark, find_file(spark, root, f"{prefix}_source{n}.tsv")).withColumn("src", F.lit(n - 1))
        out = part if out is None else out.unionByName(part)
    return normalise(before(out) if before else out, any_script=any_script)


def hold_out(anchors: DataFrame, held: int, train: int, seed: int = 42) -> DataFrame:
    """Anchors (i) with part: 'held', 'train' or 'rest', the first `held` and the next `train` in the order of a hash of the id; the counts
    are exact and the choice is the same under any partitioning."""
    from pyspark.sql import Window

    bins = anchors.select("i", F.xxhash64("i", F.lit(seed)).alias("h")).withColumn("b", F.shiftright("h", 48))
    counts = bins.groupBy("b").agg(F.count("*").alias("n"))  # 65,536 rows at most
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1))).select("b", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = bins.join(F.broadcast(before), "b").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("h", "i")))
    return ranked.select("i", F.when(F.col("rank") <= held, "held").when(F.col("rank") <= held + train, "train").otherwise("rest").alias("part"))


def thin(pairs: DataFrame, share: float, seed: int = 49) -> DataFrame:
    """Pairs of a share of the anchors, chosen by hash: their targets stay as distractors of the others."""
    return pairs.filter(F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))
