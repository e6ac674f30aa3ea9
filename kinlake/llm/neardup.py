"""Near-duplicate groups by SimHash, verified by min-hash sketches inside the index's runs.

A text is the set of its five-word shingles. Its SimHash of 192 bits, in twelve segments, is indexed by deletion
variants (see `simhash`): a pair meets under an equal key if one of its segments differs in at most one bit, which
98 of 100 pairs of Jaccard similarity 0.8 do, and more above. What links is decided where the rows lie, by the same
law in a run of any size:

1. Pairs that differ in at most `SURE` bits (a similarity of about 0.93, five deviations above what pairs at 0.7
   reach) link, and a run gives a spanning forest of them.
2. Members of a run that are within `DISTANCE` bits of one that step 1 leaves apart come out once each, with their
   key; a sketch of their shingle set (one bit each of `SKETCH` min-hashes; Li and Koenig 2010) is joined to
   them, and pairs of an estimated similarity of at least `SIMILARITY` link, again as a spanning forest.

So no step makes more rows than members of runs, however large a group is. Links become components by star
contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlake.llm import simhash
from kinlake.llm.common import materialise, text_hash

WORDS = 5
BITS = 192
SEGMENTS = 12
#: Bits that a pair may differ in to be looked at: 29 are expected at a similarity of 0.8, with a deviation of 5.
DISTANCE = 42
#: Bits up to which a pair links by its fingerprints alone.
SURE = 16
#: Min-hashes in a sketch, a bit each. The estimate's deviation at 0.8 is 0.6 / sqrt(SKETCH) = 0.013.
SKETCH = 2048
#: Least estimate that links: 0.8 less a deviation or so, since half of the pairs at 0.8 are estimated below it.
SIMILARITY = 0.79
#: Ids (16 bytes each) that are broadcast to the texts, of fingerprints to look at and of rows to drop; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000

_LANES = [f"f{i}" for i in range(BITS // 64)]
_LAYOUT = simhash._layout(BITS, SEGMENTS)
#: Slot -> (lane, bit of the lane, whether it is its segment's first).
_SLOTS = [(lane, first + b, b == 0) for lane, first, size in _LAYOUT for b in range(size)]


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Another hash of 64-bit hashes for each lane (the finaliser of SplitMix64)."""
    z = h + np.uint64((lane * 0x9E3779B97F4A7C15) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of the text's shingles, ascending; none for a blank text."""
    from xxhash import xxh64_intdigest

    return np.unique(np.array(list(map(xxh64_intdigest, simhash.shingles(text, words))), dtype=np.uint64))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set: a bit is 1 if set in more than half of the members' hashes. The empty set's is zero."""
    out = np.zeros(len(_LANES), dtype="<u8")
    for lane in range(len(_LANES) if len(hashes) else 0):
        votes = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), 65536):
            h = _mixed(hashes[at : at + 65536], lane)
            votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[lane] = np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0]
    return out


_FACTORS = _mixed(np.arange(1, SKETCH + 1, dtype=np.uint64), 7) | np.uint64(1)


def sketch(hashes: np.ndarray) -> bytes:
    """A bit of the least of the members' hashes, for each of SKETCH hash functions. Sets of similarity J agree in
    (1 + J) / 2 of the bits on average."""
    if not len(hashes):
        return bytes(SKETCH // 8)
    h, least = _mixed(hashes, 3), np.empty(SKETCH, dtype=np.uint64)
    step = max(1, (1 << 18) // len(h))
    for at in range(0, SKETCH, step):
        least[at : at + step] = (_FACTORS[at : at + step, None] * h).min(axis=1)
    return np.packbits(_mixed(least, 5) & np.uint64(1) == 1, bitorder="little").tobytes()


def _forest(pairs: Iterator[tuple[int, int]]) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Pairs that join two trees when they come, and each member's root."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            parent[b] = a
            kept.append((i, j))
    return kept, {x: find(x) for x in list(parent)}


def _sides(f: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """The bit that a row's variant leaves out."""
    lane, bit = np.array([s[0] for s in _SLOTS])[slot], np.array([s[1] for s in _SLOTS], dtype=np.uint64)[slot]
    return (f[np.arange(len(f)), lane] >> bit & np.uint64(1)).astype(bool)


_FIRST = np.array([s[2] for s in _SLOTS])


def _large_run(f: np.ndarray, side: np.ndarray, slot: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """What `_scan` finds in one run, in memory linear in its members: a forest of sure links, and who is near a member of
    another tree. Members that have the slot's bit alike share the segment's first slot and are compared there."""
    tree, near = np.full(len(f), -1), np.zeros(len(f), dtype=bool)
    rest, edges, trees = np.arange(len(f)), [], 0

    def owned(at: int, js: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        js = js if _FIRST[slot] else js[side[js] != side[at]]
        x = f[js] ^ f[at]
        d = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
        few = np.flatnonzero(d <= DISTANCE)
        if len(few):
            few = few[simhash._owned(x[few], slot, _LAYOUT)]
        return js[few], d[few]

    while len(rest):
        queue, head = [int(rest[0])], 0
        tree[rest[0]] = trees
        rest = rest[1:]
        while head < len(queue):
            at = queue[head]
            head += 1
            js, d = owned(at, rest)
            if len(js):
                near[at] = near[js] = True
                hit = js[d <= SURE]
                if len(hit):
                    edges += [(at, int(j)) for j in hit]
                    tree[hit] = trees
                    queue += hit.tolist()
                    rest = rest[tree[rest] < 0]
        trees += 1
    out = np.zeros(len(f), dtype=bool)
    some = np.flatnonzero(near)
    for i in some if len(some) and (tree[some] != tree[some[0]]).any() else ():
        if not out[i]:
            js, _ = owned(int(i), some[tree[some] != tree[i]])
            if len(js):
                out[i] = out[js] = True
    return edges, out


def candidates(nodes: DataFrame, block: int = simhash.BLOCK) -> DataFrame:
    """Of `nodes` (node, f0, ...): rows with `b` are sure links (a, b); rows without are members `a` of the run (key, slot)
    that are near another one which sure links of that run don't join to them, with the `side` of the slot's bit."""
    names = ["a", "b", "key", "slot", "side"]

    def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, slot, node, *f in simhash._whole_runs(batches, ["key", "slot", "node", *_LANES]):
            f = np.stack(f, axis=1).view(np.uint64)
            side = _sides(f, slot)
            starts, ends = simhash._bounds(key, slot)
            edges: list[tuple[int, int]] = []
            apart = np.zeros(len(key), dtype=bool)
            found = []
            for i, j in simhash._small_pairs(key, slot, starts, ends):
                d = np.bitwise_count(f[i] ^ f[j]).sum(axis=1, dtype=np.int64)
                few = np.flatnonzero(d <= DISTANCE)
                if len(few):
                    i, j = i[few], j[few]
                    own = simhash._owned(f[i] ^ f[j], slot[i], _LAYOUT)
                    found.append(np.stack([i[own], j[own], d[few][own]]))
            if found:
                x = np.concatenate(found, axis=1)
                edges, root = _forest(zip(*x[:2, x[2] <= SURE].tolist(), strict=True))
                for i, j in x[:2, x[2] > SURE].T.tolist():
                    if root.get(i, i) != root.get(j, j):
                        apart[i] = apart[j] = True
            for a, b in zip(starts, ends, strict=True):
                if b - a > simhash.SMALL:
                    more, out = _large_run(f[a:b], side[a:b], int(slot[a]))
                    edges += [(a + i, a + j) for i, j in more]
                    apart[a:b] = out
            if edges:
                x = np.array(edges).T
                gone = [pa.nulls(len(x[0]), t) for t in (pa.int64(), pa.int32(), pa.bool_())]
                yield pa.RecordBatch.from_arrays([pa.array(node[x[0]]), pa.array(node[x[1]]), *gone], names=names)
            if apart.any():
                n = int(apart.sum())
                own = [pa.array(node[apart]), pa.nulls(n, pa.int64()), pa.array(key[apart]), pa.array(slot[apart].astype(np.int32)), pa.array(side[apart])]
                yield pa.RecordBatch.from_arrays(own, names=names)

    rows = simhash.index(nodes, BITS, SEGMENTS, block)
    return rows.repartition("key").sortWithinPartitions("key", "slot").mapInArrow(_scan, "a bigint, b bigint, key bigint, slot int, side boolean")


def sketch_links(members: DataFrame) -> DataFrame:
    """Links (a, b) inside the runs of `members` (node, key, slot, side, sketch): a spanning forest of the pairs whose
    estimated similarity is at least SIMILARITY."""
    most = int(SKETCH * (1 - SIMILARITY) / 2 + 1e-9)  # differing bits

    def run_forest(w: np.ndarray, side: np.ndarray, every: bool) -> Iterator[tuple[int, int]]:
        rest = np.arange(len(w))
        while len(rest):
            queue, head, rest = [int(rest[0])], 0, rest[1:]
            while head < len(queue) and len(rest):
                at = queue[head]
                head += 1
                js = rest if every else rest[side[rest] != side[at]]
                hit = js[np.bitwise_count(w[js] ^ w[at]).sum(axis=1, dtype=np.int64) <= most]
                if len(hit):
                    yield from ((at, int(j)) for j in hit)
                    queue += hit.tolist()
                    rest = np.setdiff1d(rest, hit, assume_unique=True)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = (_with_words(b) for b in batches)
        for key, slot, node, side, w in simhash._whole_runs(wide, ["key", "slot", "node", "side", "words"]):
            starts, ends = simhash._bounds(key, slot)
            found = []
            for i, j in simhash._small_pairs(key, slot, starts, ends):
                for at in range(0, len(i), 8192):
                    x, y = i[at : at + 8192], j[at : at + 8192]
                    hit = np.bitwise_count(w[x] ^ w[y]).sum(axis=1, dtype=np.int64) <= most
                    found += zip(x[hit].tolist(), y[hit].tolist(), strict=True)
            edges, _ = _forest(iter(found))
            for a, b in zip(starts, ends, strict=True):
                if b - a > simhash.SMALL:
                    edges += [(a + i, a + j) for i, j in run_forest(w[a:b], side[a:b], bool(_FIRST[slot[a]]))]
            if edges:
                x = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(node[x[0]]), pa.array(node[x[1]])], names=["a", "b"])

    return members.repartition("key").sortWithinPartitions("key", "slot").mapInArrow(scan, "a bigint, b bigint")


class _Columns:
    """Columns of a batch as NumPy arrays, as `_whole_runs` reads them."""

    def __init__(self, columns: dict[str, np.ndarray]):
        self.columns = columns

    def column(self, name: str) -> _Columns:
        self.chosen = self.columns[name]
        return self

    def to_numpy(self) -> np.ndarray:
        return self.chosen


def _with_words(batch: pa.RecordBatch) -> _Columns:
    out = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "slot", "node", "side")}
    out["words"] = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint64).reshape(-1, SKETCH // 64)
    return _Columns(out)


def _mapped(rows: DataFrame, schema: str, names: list[str], of) -> DataFrame:
    """`rows` (doc_id, hash, text) without the text, with the columns `names` that `of` makes of its shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = of([shingle_hashes(t) for t in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=["doc_id", "hash", *names])

    return rows.select("doc_id", "hash", "text").mapInArrow(run, f"doc_id bigint, hash bigint, {schema}")


def _fingerprints(sets: list[np.ndarray]) -> list[pa.Array]:
    f = np.array([fingerprint(s) for s in sets], dtype=np.uint64).reshape(-1, len(_LANES))
    return [pa.array(np.ascontiguousarray(f[:, i]).view(np.int64)) for i in range(len(_LANES))]


def _sketches(sets: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([sketch(s) for s in sets], pa.binary())]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of the text; null is empty) and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash(docs).alias("hash"), text.alias("text"))


def components_of(docs: DataFrame, block: int = simhash.BLOCK) -> tuple[DataFrame, DataFrame]:
    """Two tables: doc_id, hash (see `keyed`) and fingerprint of every row of `docs`; and of every distinct fingerprint, with its
    first doc_id and hash, and `group`, a number that near-duplicates share."""
    rows = keyed(docs)
    prints = materialise(_mapped(rows, ", ".join(f"{n} bigint" for n in _LANES), _LANES, _fingerprints), "fingerprints")
    nodes = prints.groupBy(*_LANES).agg(F.min(F.struct("doc_id", "hash")).alias("r"))
    nodes = materialise(nodes.select(*_LANES, "r.doc_id", "r.hash", F.monotonically_increasing_id().alias("node")), "nodes")
    found = materialise(candidates(nodes, block), "candidates")
    apart = found.filter("b IS NULL").select(F.col("a").alias("node"), "key", "slot", "side")
    shown = materialise(nodes.join(apart.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "hash"), "looked-at")
    few = F.broadcast(shown) if shown.count() <= BROADCAST_ROWS else shown
    texts = rows.join(few.select("doc_id", "hash"), ["doc_id", "hash"], "left_semi")
    sketches = materialise(_mapped(texts, "sketch binary", ["sketch"], _sketches).dropDuplicates(["doc_id", "hash"]), "sketches")
    sketches = sketches.join(shown, ["doc_id", "hash"]).select("node", "sketch")
    links = found.filter("b IS NOT NULL").select("a", "b").unionByName(sketch_links(apart.join(sketches, "node")))
    joined = simhash.components(links)
    classes = nodes.join(joined, "node", "left").select(*_LANES, "doc_id", "hash", F.coalesce("component", "node").alias("group"))
    return prints, materialise(classes, "classes")


def groups(docs: DataFrame, block: int = simhash.BLOCK) -> DataFrame:
    """doc_id, hash (see `keyed`), and group of every row of `docs`: rows of one group are near-duplicates, directly or by
    others. Rows that share a doc_id are told apart by their texts; blank and null texts are one group. Other columns are
    not read; an empty table gives no rows."""
    prints, classes = components_of(docs, block)
    return prints.join(classes.select(*_LANES, "group"), _LANES).select("doc_id", "hash", "group")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, with all columns of `docs`: that of the smallest doc_id (then of the
    smallest hash of the text); of rows that repeat doc_id and text, one. Rows with a null doc_id stay, as no
    decision names them. Null and blank texts are one group. An empty table gives no rows."""
    prints, classes = components_of(docs.filter("doc_id IS NOT NULL"))
    best = classes.groupBy("group").agg(F.min(F.struct("doc_id", "hash")).alias("k")).select("k.*", F.lit(True).alias("_stays"))
    rows = prints.groupBy("doc_id", "hash").agg(F.count("*").alias("n")).join(best, ["doc_id", "hash"], "left").na.fill(False, ["_stays"])
    drop = rows.filter("NOT _stays OR n > 1").select(F.col("doc_id").alias("_dropped_id"), F.col("hash").alias("_dropped_hash"), "_stays")
    drop = materialise(drop, "decisions")
    drop = F.broadcast(drop) if drop.count() <= BROADCAST_ROWS else drop
    here = text_hash(docs)
    same = lambda df: (docs["doc_id"].cast("bigint") == df["_dropped_id"]) & (here == df["_dropped_hash"])
    kept = docs.join(drop, same(drop), "left_anti")  # null ids stay
    again = drop.filter("_stays")
    if not again.limit(1).count():
        return kept
    once = docs.join(again, same(again), "left_semi").withColumn("_text_hash", here).dropDuplicates(["doc_id", "_text_hash"]).drop("_text_hash")
    return kept.unionByName(once)
