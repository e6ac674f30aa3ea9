"""Token ids as Arrow stream files of equal-length sequences.

Every file holds a run of documents, ascending by doc_id: their ids, end ids included, one after the other,
cut into rows of `length` ids. A record batch has `batch_rows` rows of two fixed-size lists, the ids and a
mask that is false on the last row's padding. All full batches take the same number of bytes, so that row i
lies at an offset known by arithmetic, and a memory map gives it without copying. Beside each file lies an
index, an Arrow stream file too, with one fixed-size list [doc_id, start in the file, ids] per document.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlake.llm.common import documents, materialise, new_folder, shuffle_partitions, storage
from kinlake.llm.tokens import encoder, vocabulary, vocabulary_size

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
LENGTH = 1024
BATCH_ROWS = 64
_NO_ID = -(1 << 63)


def schema_of(length: int, wide: bool) -> pa.Schema:
    ids = pa.list_(pa.field("item", pa.uint32() if wide else pa.uint16(), nullable=False), length)
    mask = pa.list_(pa.field("item", pa.bool_(), nullable=False), length)
    return pa.schema([pa.field("ids", ids, nullable=False), pa.field("mask", mask, nullable=False)], metadata={"length": str(length)})


class StreamWriter:
    """Appends ids to a sink and writes a batch whenever one is full; memory is one batch."""

    def __init__(self, sink, length: int = LENGTH, batch_rows: int = BATCH_ROWS, wide: bool = False):
        self.schema, self.length, self.size = schema_of(length, wide), length, length * batch_rows
        self.writer = pa.ipc.new_stream(sink, self.schema)
        self.kind, self.parts, self.held, self.total = np.uint32 if wide else np.uint16, [], 0, 0

    def append(self, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) > np.iinfo(self.kind).max:
            raise ValueError(f"id {int(ids.max())} does not fit the file's {self.kind.__name__} ids")
        self.parts.append(ids.astype(self.kind))
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.size:
            every = np.concatenate(self.parts)
            whole = len(every) // self.size * self.size
            for at in range(0, whole, self.size):
                self._write(every[at : at + self.size], self.size)
            self.parts, self.held = [every[whole:]], len(every) - whole

    def _write(self, ids: np.ndarray, real: int) -> None:
        kinds = self.schema.field("ids").type, self.schema.field("mask").type
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=t) for x, t in zip((ids, np.arange(len(ids)) < real), kinds, strict=True)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            ids = np.concatenate(self.parts)
            padded = np.zeros(-(-len(ids) // self.length) * self.length, dtype=self.kind)
            padded[: len(ids)] = ids
            self._write(padded, len(ids))
        self.writer.close()


class StreamReader:
    """Random access to rows of a stream file held in `buffer` (a memory map, for no copies)."""

    def __init__(self, buffer: pa.Buffer):
        self.buffer = buffer
        at = self._message(0)
        self.schema = pa.ipc.read_schema(pa.BufferReader(buffer))
        self.length, self.head = int(self.schema.metadata[b"length"]), at
        self.rows_a_batch = self.stride = self.rows = 0
        if not self._end(at):
            self.stride = self._message(at) - at
            self.rows_a_batch = self.rows = self._batch(at).num_rows
            # The last batch may be short: full batches are counted by their stride, the rest is read.
            body = buffer.size - at
            full = body // self.stride
            last = at + full * self.stride
            if full and not self._end(last):
                self.rows = full * self.rows_a_batch + self._batch(last).num_rows
            else:
                self.rows = full * self.rows_a_batch

    def _end(self, at: int) -> bool:
        return at + 8 > self.buffer.size or int.from_bytes(self.buffer[at + 4 : at + 8].to_pybytes(), "little") == 0

    def _message(self, at: int) -> int:
        """Where the message after the one at `at` begins."""
        source = pa.BufferReader(self.buffer[at:])
        pa.ipc.read_message(source)
        return at + source.tell()

    def _batch(self, at: int) -> pa.RecordBatch:
        return pa.ipc.read_record_batch(pa.ipc.read_message(pa.BufferReader(self.buffer[at:])), self.schema)

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of row i; the ids are a view of the buffer."""
        if not 0 <= i < self.rows:
            raise IndexError(i)
        batch = self._batch(self.head + i // self.rows_a_batch * self.stride)
        k = i % self.rows_a_batch
        ids, mask = (batch.column(c).values.slice(k * self.length, self.length) for c in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)


def write(docs: DataFrame, folder: str | None = None, vocabulary_name: str = VOCABULARY, end_id: int = END_ID, length: int = LENGTH, wide: bool | None = None) -> DataFrame:
    """Write `docs` and return the manifest: part, file, documents, tokens, start (tokens of earlier files).

    Documents are dealt out by ranges of doc_id (then of the text's hash), nulls first, sorted, encoded whole
    and written by the task that sorted them. A file is named afresh by each attempt, and only the manifest, a
    written table, says which files count: a repeated task leaves an orphan and no damage. A null text is
    empty: its end id alone. Repeated rows are written as often as they come, and an empty table gives no file. `wide`
    stores 32-bit ids; by default, those of vocabularies that 16 bits don't hold.
    """
    spark = docs.sparkSession
    if wide is None:
        wide = max(vocabulary_size(vocabulary(vocabulary_name)), end_id + 1) > 1 << 16
    folder = folder or new_folder(spark, "token-stream")
    n = shuffle_partitions(spark)
    ordered = (
        docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text")).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
        .select(F.spark_partition_id().alias("part"), "doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = part = None
        entries: list[tuple[int, int, int]] = []
        encode, end = encoder(vocabulary(vocabulary_name)), end_id.to_bytes(4, "little")
        fs, at = storage(folder)
        name = f"{uuid.uuid4().hex}.arrows"
        for batch in batches:
            parts = (batch.slice(k, 256) for k in range(0, batch.num_rows, 256))  # few texts at a time as Python strings
            for p, doc_id, text in (row for x in parts for row in zip(*(c.to_pylist() for c in x.columns), strict=True)):
                if writer is None:
                    fs.create_dir(at, recursive=True)
                    sink, part = fs.open_output_stream(f"{at}/{name}"), p
                    writer = StreamWriter(sink, length, wide=wide)
                ids = np.frombuffer(encode(text) + end, dtype="<u4")
                entries.append((_NO_ID if doc_id is None else doc_id, writer.total, len(ids)))
                writer.append(ids)
        if writer is not None:
            writer.close()
            sink.close()
            flat = pa.array(np.array(entries, dtype=np.int64).ravel())
            index = pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(flat, 3)], names=["document"])
            with fs.open_output_stream(f"{at}/{name}.index") as out, pa.ipc.new_stream(out, index.schema) as w:
                w.write_batch(index)
            row = [part], [f"{folder}/{name}"], [len(entries)], [writer.total]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), *map(pa.array, row[1:])], names=["part", "file", "documents", "tokens"])

    files = materialise(ordered.mapInArrow(run, "part int, file string, documents bigint, tokens bigint"), "token-manifest")
    found = sorted(files.collect(), key=lambda r: r["part"])  # a row per file
    starts, rows = 0, []
    for r in found:
        rows.append((*r, starts))
        starts += r["tokens"]
    return spark.createDataFrame(rows, "part int, file string, documents bigint, tokens bigint, start bigint")


def read(spark: SparkSession, manifest: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the manifest's files, read batch by batch. Repeated documents
    come back as often as they were written, a null id as null; an empty manifest gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, at = storage(uri)
                with fs.open_input_stream(f"{at}.index") as f, pa.ipc.open_stream(f) as r:
                    index = np.concatenate([b.column(0).flatten().to_numpy() for b in r]).reshape(-1, 3)
                crcs = np.zeros(len(index), dtype=np.int64)
                with fs.open_input_stream(at) as f, pa.ipc.open_stream(f) as r:
                    doc, pos, crc = 0, 0, 0
                    for b in r:
                        ids = b.column(0).flatten().to_numpy().astype("<u4")
                        mask = b.column(1).flatten()
                        ids = ids[: int(mask.true_count)]
                        done = 0
                        while doc < len(index):
                            stop = index[doc, 1] + index[doc, 2] - pos
                            crc = zlib.crc32(ids[done : min(stop, len(ids))].tobytes(), crc)
                            if stop > len(ids):
                                break
                            crcs[doc], crc, done, doc = crc, 0, stop, doc + 1
                        pos += len(ids)
                if doc != len(index):
                    raise OSError(f"{uri} ends early")
                for k in range(0, len(index), 50_000):
                    x = index[k : k + 50_000]
                    ids = pa.array(x[:, 0], mask=x[:, 0] == _NO_ID)
                    cols = [ids, pa.array(x[:, 1] + before), pa.array(x[:, 2]), pa.array(crcs[k : k + 50_000])]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("file", "start").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def open_local(path: str) -> StreamReader:
    """Random access to a file on this machine's storage, memory-mapped."""
    return StreamReader(pa.memory_map(os.fspath(path)).read_buffer())


def op8_arrow_stream(spark, sf_dir: str) -> DataFrame:
    """Every document's place in the stream files, read back from them; see `write` and `read`."""
    manifest = write(documents(spark, sf_dir))
    return read(spark, manifest.repartition(shuffle_partitions(spark)))
