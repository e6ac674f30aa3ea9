"""Shortest-pack-first histogram packing (Krell et al. 2021, "Efficient Sequence Packing without
Cross-contamination").

A document's ids plus one end id are cut into pieces of at most `capacity`: whole sequences and one rest.
The pieces' length histogram (at most `capacity` bins) is packed on the driver, longest lengths first,
each into the emptiest open packs that hold it; what comes out is a short list of packing patterns with
counts. Patterns are joined back to the pieces by their rank within their length, so that no step but the
tokenizer sees ids and none sees all the documents of a length.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlake.llm.common import documents, global_rank, long_array, materialise
from kinlake.llm.tokens import encoder, vocabulary

CAPACITY = 1024
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
#: Pieces that are packed together where an order is to be kept.
WINDOW = 8192

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary_name: str = VOCABULARY, end_id: int = END_ID, position: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start (the document's ids before it), length, ids_crc32, doc_tokens, and `position`, a
    bigint of the document, if one is named.

    A null or empty text is its end id alone. Texts are encoded whole; a document of n ids gives
    ceil(n / capacity) pieces. Repeated rows give repeated pieces; other columns are not read.
    """
    also = [position] if position else []
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *also]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary(vocabulary_name)), end_id.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):  # few texts at a time as Python strings
                for doc_id, text, *more in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    ids = encode(text or "") + end
                    n = len(ids) // 4
                    for at in range(0, n, capacity):
                        k = min(capacity, n - at)
                        out.append((doc_id, at, k, zlib.crc32(ids[4 * at : 4 * (at + k)]), n, *more))
            cols = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return docs.select(F.col("doc_id").cast("bigint"), "text", *also).mapInArrow(cut, ", ".join([PIECES, *(f"{c} bigint" for c in also)]))


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a pack, count of such packs) for a histogram of length -> count.

    Lengths come longest first. Each goes to the open packs with the most room; a pattern with more packs
    than pieces left is split in two. Patterns that can't hold the length stay open for shorter ones.
    """
    done: list[tuple[tuple[int, ...], int]] = []
    room: dict[int, list[list]] = defaultdict(list)  # free space -> [lengths, count] patterns
    spaces: list[int] = []  # ascending free spaces that have patterns
    for length in sorted(histogram, reverse=True):
        left, opened = histogram[length], []
        while left:
            if spaces and spaces[-1] >= length:
                space = spaces[-1]
                lengths, count = room[space].pop()
                used = min(left, count)
                if used < count:
                    room[space].append([lengths, count - used])
                if not room[space]:
                    spaces.pop()
            else:
                space, lengths, used = capacity, (), left
            left -= used
            opened.append((space - length, lengths + (length,), used))
            # A pack that takes this length may take it again: it goes back at once.
            free, pattern, count = opened.pop()
            if free == 0:
                done.append((pattern, count))
            else:
                if not room[free]:
                    insort(spaces, free)
                room[free].append([pattern, count])
    done += [(tuple(p), c) for packs in room.values() for p, c in packs]
    return [(p, c) for p, c in done if c]


def placement(patterns: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Patterns as intervals of ranks: the pieces of `length` with ranks from `first` on take `offset` in the
    sequences from `sequence` on. Sorted by (length, first); `at` has where each length's intervals begin."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, count in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, used[length], sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    key = table[:, 0] * (1 << 48) + table[:, 1]
    return {"key": key, "first": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary_name: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Pieces with sequence_id, offset, sequence_length and padded_length.

    Sequences are gapless from 0 in sequence_id and in offset. A sequence whose length is a power of two
    stays as it is, others are padded to `capacity`. An empty table gives no rows; null ids are kept.
    """
    spark = docs.sparkSession
    cut = materialise(pieces(docs, capacity, vocabulary_name, end_id), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # capacity rows at most
    patterns = shortest_pack_first(histogram, capacity)
    table = spark.sparkContext.broadcast(placement(patterns, capacity))  # bounded by patterns, not by documents
    before, total = np.zeros(capacity + 1, dtype=np.int64), 0
    for length in range(1, capacity + 1):
        before[length] = total
        total += histogram.get(length, 0)
    sizes = spark.sparkContext.broadcast(
        (np.cumsum([0] + [c for _, c in patterns]), np.array([sum(p) for p, _ in patterns], dtype=np.int64))
    )
    ranked = global_rank(cut, ["length", "doc_id", "start", "ids_crc32"], "packed")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, (starts, lengths) = table.value, sizes.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("pos").to_numpy() - before[length]
            at = np.searchsorted(t["key"], length * (1 << 48) + rank, side="right") - 1
            sequence = t["sequence"][at] + rank - t["first"][at]
            whole = lengths[np.searchsorted(starts, sequence, side="right") - 1] if len(lengths) else length
            padded = np.where((whole & (whole - 1)) == 0, whole, capacity)
            new = [pa.array(x, pa.int64()) for x in (sequence, t["offset"][at], whole, padded)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + new,
                names=[*names, "sequence_id", "offset", "sequence_length", "padded_length"],
            )

    schema = PIECES + ", sequence_id bigint, offset bigint, sequence_length bigint, padded_length bigint"
    return ranked.mapInArrow(place, schema)


def pack_in_order(docs: DataFrame, position: str, capacity: int = CAPACITY, window: int = WINDOW, vocabulary_name: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """`pack`, but sequences follow the documents' order by `position`, a bigint column: each `window` pieces in a row are
    packed by themselves, and a window's sequences come before the next one's, numbered by their earliest pieces."""
    cut = materialise(pieces(docs, capacity, vocabulary_name, end_id, position), "pieces")
    ranked = global_rank(cut, [position, "doc_id", "start", "ids_crc32"], "ordered")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "ascending"), ("pos", "ascending")])
        length, pos = table["length"].to_numpy(), table["pos"].to_numpy()
        lengths, first, count = np.unique(length, return_index=True, return_counts=True)
        t = placement(shortest_pack_first(dict(zip(lengths.tolist(), count.tolist(), strict=True)), capacity), capacity)
        rank = np.arange(len(length)) - np.repeat(first, count)
        at = np.searchsorted(t["key"], length * (1 << 48) + rank, side="right") - 1
        sequence = t["sequence"][at] + rank - t["first"][at]
        earliest = np.full(sequence.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(earliest, sequence, pos)
        whole = np.bincount(sequence, weights=length).astype(np.int64)[sequence]
        number = np.empty(len(earliest), dtype=np.int64)
        number[np.argsort(earliest)] = np.arange(len(earliest))
        padded = np.where((whole & (whole - 1)) == 0, whole, capacity)
        new = {"sequence_id": number[sequence], "offset": t["offset"][at], "sequence_length": whole, "padded_length": padded, "window": pos // window}
        return pa.table({**{n: table[n] for n in names}, **{n: pa.array(x, pa.int64()) for n, x in new.items()}})

    schema = PIECES + ", sequence_id bigint, offset bigint, sequence_length bigint, padded_length bigint"
    grouped = ranked.withColumn("window", F.floor(F.col("pos") / F.lit(window))).groupBy("window")
    placed = materialise(grouped.applyInArrow(place, schema + ", window bigint"), "windows")
    counts = sorted((r["window"], r["n"]) for r in placed.groupBy("window").agg((F.max("sequence_id") + 1).alias("n")).collect())  # a number per window
    starts = np.cumsum([0] + [n for _, n in counts]).tolist()
    return placed.withColumn("sequence_id", F.col("sequence_id") + F.element_at(long_array(starts), (F.col("window") + 1).cast("int"))).drop("window")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence; see `pack`."""
    return pack(documents(spark, sf_dir))
