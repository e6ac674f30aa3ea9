"""Per-document text statistics, computed in one pass over Arrow batches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Column -> meaning. Words are runs of characters other than ASCII blanks.
STATS = ("n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_digits", "n_stops")


def repeat_words(words: list, window: int = WINDOW) -> int:
    """Words in windows of `window` words that occur twice or more, the first occurrence included."""
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    counts, total, end = Counter(grams), 0, 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            total += i + window - max(i, end)
            end = i + window
    return total


def stats(text: str | None) -> tuple[int, ...]:
    """The values of STATS for a whole text; null counts as empty."""
    t = text or ""
    words = t.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII blanks only
    lines = [x for x in t.split("\n") if x.strip(BLANKS)]
    return (
        len(t), len(words), len(t) - sum(map(t.count, BLANKS)), sum(map(t.count, SYMBOLS)), len(lines),
        len(lines) - len(set(lines)), repeat_words(words), len(set(words)), sum(map(t.count, "0123456789")),
        sum(map(t.count, (". ", ".\n", "? ", "! "))),
    )


def text_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns in `keep` and STATS (bigint) for each row, in one pass without a shuffle."""
    n = len(keep) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [stats(t) for t in batch.column(n).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(STATS)
            own = [batch.column(i) for i in range(n)]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", *keep, *STATS])

    rows = docs.select(F.col("doc_id").cast("bigint"), *keep, F.col("text").cast("string"))
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{head}, " + ", ".join(f"{s} bigint" for s in STATS))


def with_text_stats(docs: DataFrame, prefix: str) -> DataFrame:
    """`docs` with STATS of its texts as columns named with `prefix`: rows pass by as they are, so that a filter on them needs no
    join back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [stats(t) for t in batch.column(at).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(STATS)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in cols)], names=[*batch.schema.names, *names])

    names, at = [f"{prefix}{s}" for s in STATS], docs.columns.index("text")
    schema = StructType([*docs.schema.fields, *(StructField(n, LongType()) for n in names)])
    return docs.mapInArrow(run, schema)
