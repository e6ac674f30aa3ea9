"""SimHash near-duplicates: weighted bit votes over word shingles, found by deletion variants.

Two fingerprints within `distance` bits, cut into `segments` parts with distance < 2 * segments, have a part
that differs in at most one bit. Each part is indexed once per bit with that bit taken out (a one-wildcard
variant), so that such a pair meets under an equal key; there the whole fingerprints are compared. Equal
fingerprints are one node from the start. Within a key's run only a spanning forest of links comes out, so
a group of any size gives rows in proportion to its members; large runs are dealt out by blocks of
members. Links become components by distributed star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlake.llm.common import documents, materialise

WORDS = 4
BITS = 64
DISTANCE = 4
SEGMENTS = 3
#: A key's run of more members is split into blocks of about so many, compared block by block.
BLOCK = 8192
#: Runs of up to so many members are compared many at a time.
SMALL = 64
_SEEDS = 42
_LOWER = bytes(range(256)).lower()


def shingles(text: str | None, words: int = WORDS) -> list[bytes]:
    """Word shingles with repeats: A-Z lower-cased, words of non-blank bytes; the whole sequence if there are fewer words."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if len(w) < words:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)))


def fingerprint(text: str | None, words: int = WORDS, lanes: int = 1) -> np.ndarray:
    """`lanes` unsigned 64-bit SimHash words of a text: A-Z lower-cased, words of non-blank bytes, shingles with
    repeats. A bit is 1 if set in more than half the shingles' XXH64 (seed 42, 43, ...). No words: zero."""
    from xxhash import xxh64_intdigest

    parts = shingles(text, words)
    if not parts:
        return np.zeros(lanes, dtype=np.uint64)
    out = np.zeros(lanes, dtype="<u8")
    for lane in range(lanes):
        seed, votes = _SEEDS + lane, np.zeros(64, dtype=np.int64)
        for at in range(0, len(parts), 65536):
            h = np.array([xxh64_intdigest(s, seed) for s in parts[at : at + 65536]], dtype="<u8")
            votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[lane] = np.packbits(2 * votes > len(parts), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """doc_id and f0, f1, ...: the fingerprint's 64-bit words as bigint (two's complement)."""
    lanes = bits // 64
    names = [f"f{i}" for i in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([fingerprint(t, words, lanes) for t in batch.column(1).to_pylist()], dtype=np.uint64).reshape(-1, lanes)
            cols = [pa.array(np.ascontiguousarray(f[:, i]).view(np.int64)) for i in range(lanes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", *names])

    schema = "doc_id bigint, " + ", ".join(f"{n} bigint" for n in names)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def _layout(bits: int, segments: int) -> list[tuple[int, int, int]]:
    """(lane, first bit, length) of each segment; segments don't straddle 64-bit words."""
    lanes = bits // 64
    if segments % lanes:
        raise ValueError("segments must be a multiple of bits / 64")
    per, out = segments // lanes, []
    for lane in range(lanes):
        at = 0
        for k in range(per):
            size = (64 - at) // (per - k)
            out.append((lane, at, size))
            at += size
    return out


def _variants(f: np.ndarray, layout: list[tuple[int, int, int]]) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, key) for every bit of every segment: the slot's number above the segment's value without that bit."""
    slot = 0
    for lane, first, size in layout:
        value = (f[:, lane] >> np.uint64(first)) & np.uint64((1 << size) - 1)
        for bit in range(size):
            yield slot, (value & ~np.uint64(1 << bit)).astype(np.int64) + (np.int64(slot) << np.int64(40))
            slot += 1


def _near(f: np.ndarray, i: np.ndarray, j: np.ndarray, slot: np.ndarray, layout, distance: int) -> np.ndarray:
    """Whether pairs (i, j) link, and this slot is the first that they share: so each link is made once."""
    ok = np.bitwise_count(f[i] ^ f[j]).sum(axis=1, dtype=np.int64) <= distance
    few = np.flatnonzero(ok)  # next to none, in most runs
    if len(few):
        ok[few] = _owned(f[i[few]] ^ f[j[few]], slot[few], layout)
    return ok


def _owned(x: np.ndarray, slot: np.ndarray | int, layout) -> np.ndarray:
    """Whether `slot` is the first that a pair of fingerprints shares; x are the pairs' differing bits."""
    own, settled, slot0 = np.zeros(len(x), dtype=bool), np.zeros(len(x), dtype=bool), 0
    for lane, first, size in layout:
        d = (x[:, lane] >> np.uint64(first)) & np.uint64((1 << size) - 1)
        n = np.bitwise_count(d)
        here = (n <= 1) & ~settled
        bit = np.where(n == 0, 0, np.bitwise_count(d - (d > 0).astype(np.uint64)))
        own |= here & (slot == slot0 + bit)
        settled |= here
        slot0 += size
    return own


def _forest(f: np.ndarray, slot: int, layout, distance: int) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest over one run, in memory linear in its members."""
    rest = np.arange(1, len(f))
    queue, head = [0], 0
    while True:
        if head == len(queue):
            if not len(rest):
                return
            queue.append(int(rest[0]))
            rest = rest[1:]
        at = queue[head]
        head += 1
        if len(rest):
            hit = _near(f, np.full(len(rest), at), rest, np.full(len(rest), slot), layout, distance)
            for j in rest[hit]:
                yield at, int(j)
            queue += rest[hit].tolist()
            rest = rest[~hit]


def index(nodes: DataFrame, bits: int = BITS, segments: int = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """key, slot, node, f0, ... of every one-wildcard variant of `nodes` (node, f0, ...); rows of equal key and slot are a
    run. Runs that may exceed `block` members are dealt out by pairs of blocks, so that any two members still meet."""
    layout = _layout(bits, segments)
    lanes = [f"f{i}" for i in range(bits // 64)]
    signature = "key bigint, slot int, node bigint, " + ", ".join(f"{n} bigint" for n in lanes)

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.stack([batch.column(n).to_numpy() for n in lanes], axis=1).view(np.uint64)
            own = [batch.column("node"), *(batch.column(n) for n in lanes)]
            for slot, key in _variants(f, layout):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), slot, dtype=np.int32)), *own], names=["key", "slot", "node", *lanes])

    signed = nodes.select("node", *lanes).mapInArrow(variants, signature)

    # Keys that may hold more than a block: from the segments' exact values, a small count with partial sums.
    values = F.array(*[
        F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(F.col(f"f{lane}"), first).bitwiseAND(F.lit((1 << size) - 1).cast("bigint")).alias("v"))
        for k, (lane, first, size) in enumerate(layout)
    ])
    hot = nodes.select(F.inline(values)).groupBy("k", "v").count().filter(F.col("count") > block // 2)
    hot = materialise(hot, "hot-segments")
    if hot.count():
        sizes, slot0, firsts = [s for _, _, s in layout], 0, []
        for s in sizes:
            firsts.append(slot0)
            slot0 += s
        wild = F.transform(
            F.sequence(F.lit(0), F.element_at(F.array(*map(F.lit, sizes)), F.col("k") + 1) - 1),
            lambda b: F.col("v").bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, 0)") * F.pow(F.lit(2), b).cast("bigint")))
            + (F.element_at(F.array(*map(F.lit, firsts)), F.col("k") + 1) + b).cast("bigint") * F.lit(1 << 40),
        )
        buckets = hot.select(F.explode(wild).alias("key"), "count").groupBy("key").agg(
            F.ceil(F.sum("count") * 2 / F.lit(block)).cast("int").alias("blocks")
        )
        mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        other = F.explode(F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0))))
        signed = (
            signed.join(buckets, "key", "left").na.fill(1, ["blocks"]).withColumn("mine", mine).withColumn("other", other)
            .withColumn("key", F.when(F.col("blocks") > 1, F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))).otherwise(F.col("key")))
            .select("key", "slot", "node", *lanes)
        )
    return signed


def links(nodes: DataFrame, bits: int = BITS, distance: int = DISTANCE, segments: int = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between `nodes` (node, f0, ...), of distinct fingerprints, that join all that is joined by pairs
    within `distance` bits. Exact when distance < 2 * segments; beyond that, a pair is found if one of its segments
    differs in at most one bit. A link may come back more than once; an empty table gives none."""
    layout, lanes = _layout(bits, segments), [f"f{i}" for i in range(bits // 64)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, slot, node, *f in _whole_runs(batches, ["key", "slot", "node", *lanes]):
            f = np.stack(f, axis=1).view(np.uint64)
            starts, ends = _bounds(key, slot)
            found: list[np.ndarray] = []
            for i, j in _small_pairs(key, slot, starts, ends):
                hit = _near(f, i, j, slot[i], layout, distance)
                found.append(np.stack([i[hit], j[hit]]))
            for a, b in zip(starts, ends, strict=True):
                if b - a > SMALL and (pairs := list(_forest(f[a:b], int(slot[a]), layout, distance))):
                    found.append(np.array(pairs).T + a)
            if found:
                x = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(node[x[0]]), pa.array(node[x[1]])], names=["a", "b"])

    return index(nodes, bits, segments, block).repartition("key").sortWithinPartitions("key", "slot").mapInArrow(scan, "a bigint, b bigint")


def _bounds(key: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of rows sorted by (key, slot) begin and end."""
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (slot[1:] != slot[:-1])])
    return starts, np.r_[starts[1:], len(key)]


def _small_pairs(key: np.ndarray, slot: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j) of rows of one run, for runs of up to `SMALL` members, for many runs at a time. Longer runs are gone
    through one by one: a matter of speed, not of what links."""
    small = np.repeat(ends - starts <= SMALL, ends - starts)
    for step in range(1, min(SMALL, len(key))):
        i = np.flatnonzero((key[:-step] == key[step:]) & (slot[:-step] == slot[step:]) & small[:-step])
        if not len(i):
            return
        yield i, i + step


def _whole_runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns `names` of batches sorted by the first, cut anew so that no value of the first is cut in two."""
    kept: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(n).to_numpy() for n in names]
        if kept is not None:
            cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last run may go on
        kept = [c[cut:] for c in cols]
        if cut:
            yield [c[:cut] for c in cols]
    if kept is not None and len(kept[0]):
        yield kept


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link. Alternating large-star and
    small-star contraction (Kiveris et al. 2014), O(log n) rounds or so; each round is written to the shared folder.
    A node's neighbours meet as a minimum with partial sums, and joins split skewed keys."""
    both = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    table = materialise(both, "links")
    for _ in range(max_rounds):
        # Large star: each larger neighbour of u links to the least of u and its neighbours.
        around = table.union(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = around.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # Small star: each smaller neighbour of u, and u, link to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        after = materialise(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        same = after.count() == table.count() and not after.join(table, ["u", "v"], "left_anti").limit(1).count()
        table = after
        if same:
            return table.select(F.col("u").alias("node"), F.col("v").alias("component"))
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS, distance: int = DISTANCE, segments: int = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """doc_id, f0, ..., component_id (smallest doc_id reachable over links of at most `distance` bits).

    Every row comes back once; null and blank texts have fingerprint zero and link like any other, equal texts
    always link. Rows with a null doc_id take part, yet name a component only if no other row does. An empty
    table gives no rows; other columns are not read.
    """
    lanes = [f"f{i}" for i in range(bits // 64)]
    prints = materialise(fingerprints(docs, words, bits), "fingerprints")
    nodes = materialise(prints.groupBy(*lanes).agg(F.min("doc_id").alias("node")), "nodes")
    joined = components(links(nodes.filter("node IS NOT NULL"), bits, distance, segments, block))
    classes = nodes.join(joined, "node", "left").select(*lanes, F.coalesce("component", "node").alias("component_id"))
    # Few fingerprints repeat; a hot one is split by the engine's skew join.
    return prints.join(materialise(classes, "classes"), lanes, "left")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component; see `near_duplicates`."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")
