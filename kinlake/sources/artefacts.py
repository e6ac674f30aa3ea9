"""What a run leaves behind: cached candidates, probabilities, models, reports, result files."""

from __future__ import annotations

import hashlib
import json
import zipfile
from collections.abc import Callable, Mapping
from io import BytesIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlake.sources import views


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, folder: str, name: str, parameters: Mapping, make: Callable[[], DataFrame], fresh: bool = False) -> DataFrame:
    """The table that `make` gives, from the folder if one of the same name and parameters was written to its end; else it is made and
    written. The path holds a digest of all parameters, so that no table serves others."""
    digest = hashlib.sha256(json.dumps(dict(parameters), sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{folder}/{name}-{digest}"
    if fresh or not _exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_probabilities(scored: DataFrame, path: str, **facts) -> None:
    """Scored pairs as Parquet, with columns of the run's choices, from which decisions can be made anew."""
    for k, v in facts.items():
        scored = scored.withColumn(k, F.lit(v))
    scored.write.mode("overwrite").parquet(path)


def write_variants(variants: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """A result file of each variant's lists; path by name."""
    out = {}
    for name, lists in variants.items():
        out[name] = f"{folder}/matching_results_{name}.tsv"
        views.write_tsv(lists, out[name])
    return out


def write_report(spark: SparkSession, path: str, facts: Mapping) -> None:
    """One JSON object, a line of text in the shared storage."""
    spark.createDataFrame([(json.dumps(dict(facts), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def package(spark: SparkSession, paths: Mapping[str, str], target: str) -> None:
    """A zip file of result files: name in it -> path of a folder of part files, whose parts follow each other under one header."""
    buffer = BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, path in paths.items():
            table = spark.read.option("wholetext", False).text(path)
            header = table.first()["value"]
            with z.open(name, "w") as f:
                f.write(f"{header}\n".encode())
                for r in table.filter(F.col("value") != header).toLocalIterator():  # a partition at a time
                    f.write(f"{r['value']}\n".encode())
    out = spark._jvm.org.apache.hadoop.fs.Path(target)
    stream = out.getFileSystem(spark._jsc.hadoopConfiguration()).create(out, True)
    stream.write(bytearray(buffer.getvalue()))
    stream.close()
