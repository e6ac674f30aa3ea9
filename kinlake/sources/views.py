"""Linkage views over a corpus, and the tab-separated tables of the linkage task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlake.functions import text as T

#: Columns of a source table.
SOURCE = ("entity_id", "business_name", "business_address", "country")


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...] = SOURCE) -> DataFrame:
    """A tab-separated table: all strings, no quoting, empty fields as '', absent columns as ''; rows without an id go, the first row
    per id by content stays, and the country is trimmed and upper-cased. Folders are searched for files."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("escape", "").option("recursiveFileLookup", True).csv(path)
    picked = raw.select(*[(F.coalesce(F.col(c), F.lit("")) if c in raw.columns else F.lit("")).alias(c) for c in columns])
    kept = picked.filter(F.col(columns[0]) != "").groupBy(columns[0]).agg(F.min(F.struct(*columns[1:])).alias("r")).select(columns[0], "r.*")
    return kept.withColumn("country", F.upper(F.trim("country"))) if "country" in columns else kept


def write_tsv(df: DataFrame, path: str) -> None:
    """The counterpart: header, tabs, no quoting, empty strings as nothing. Tabs and line ends inside values become spaces."""
    flat = df.select(*[F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[\\t\\r\\n]", " ").alias(c) for c in df.columns])
    flat.write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """source1_entity_id and matched_entity_ids (comma list) as they are."""
    return read_tsv(spark, path, ("source1_entity_id", "matched_entity_ids"))


def explode_pairs(lists: DataFrame, key: str, items: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct (i, j) of a table of comma lists whose ids exist in left.i and right.j."""
    pairs = lists.select(F.col(key).alias("i"), F.explode(F.split(items, ",")).alias("j")).select("i", F.trim("j").alias("j")).filter("j <> ''")
    return pairs.join(left.select("i"), "i", "left_semi").join(right.select("j"), "j", "left_semi").select("i", "j").distinct()


def role() -> Column:
    """0, 1 or 2: which of the three sources a document stands for."""
    return F.substring("source", 4, 10).cast("int") % 3


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a record: id, src (0 anchor, 1 and 2 targets), country, name (the first sentence), addr (all that follows),
    both folded to plain words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = F.split_part(F.col("text"), F.lit("."), F.lit(1))
    plain = lambda s: F.trim(F.regexp_replace(T.fold_ascii(s), "[^a-z0-9]+", " "))
    return docs.select(
        F.col("doc_id").alias("id"), role().alias("src"), F.upper("lang").alias("country"), plain(name).alias("name"),
        plain(F.substring("text", F.length(name) + 2, F.lit(1 << 30))).alias("addr"), name.alias("raw_name"), "text",
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as normalised records: id, src, country, full and name (all words and the core of the first sentence), addr (what
    follows), nat, dom, postal and house."""
    e = entities(spark, sf_dir)
    rest = F.substring("text", F.length("raw_name") + 2, F.lit(1 << 30))
    made = e.select("id", "src", "country", T.norm_name(F.col("raw_name")).alias("n"), T.norm_address(rest).alias("addr"), T.name_flags(F.col("raw_name")).alias("f"), T.postal_house(rest).alias("p"))
    return made.select("id", "src", "country", F.col("n.n_full").alias("full"), F.col("n.n_core").alias("name"), "addr", "f.nat", "f.dom", "p.postal", "p.house")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver links (i, j): an anchor and a target of the same text, which meet by its digest, so that no text is shuffled."""
    e = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), role().alias("src"), F.md5("text").alias("digest"))
    a, t = e.filter("src = 0").select(F.col("id").alias("i"), "digest"), e.filter("src > 0").select(F.col("id").alias("j"), "digest")
    return a.join(t, "digest").select("i", "j")
