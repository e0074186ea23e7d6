"""Self-join of documents by the Jaccard similarity of their word n-gram sets, with Bayesian pruning of candidates.

1. Each document becomes its set of shingles: a 128-bit fingerprint of the set and 160 MinHash values. Documents with equal sets
   are one *node*, a number, so copies take part once, whatever their number.
2. Bands of five values give candidate buckets (a pair of similarity 0.8 shares none of 32 bands once in 300,000).
3. In a bucket, MinHash values of each pair are compared a few at a time; after each step a pair is dropped if the posterior
   probability that its similarity reaches the threshold, given the matches so far and a uniform prior, is below
   TOLERANCE. What survives is not listed as pairs: a bucket gives a star per connected set of survivors. In a bucket of more
   than BLOCK nodes each node is first compared with the least one, in a pass without groups; the nodes that are dropped there
   are compared with the whole bucket, block by block.
4. Stars are merged to components. Any pair that can be linked lies in one component. Components of more than one block compare
   MinHash values for every two blocks, and only nodes with a surviving partner in the other block send their sets there.
5. Each pair is pruned in the same way and the rest verified exactly by intersecting the sets. A task gives
   link counts and stars of verified links per node, never pairs; the stars' components are the classes.

Links are counted between documents: a node's number is the sum of its partners' copies and its own other copies.

Defined results: a word is ``[^\\x20\\x09-\\x0D]+``, compared byte for byte; a text of fewer than n words has one shingle of all
its words; a null text, or one without a word, has no shingles, no links and a class of its own; a class is named by its
least doc_id (null only if it has no other); repeated rows are copies of each other; an empty table gives no rows. ``join``
reads no other columns, ``one_of_each`` keeps them all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.llm import textkernel as K
from quaymark.llm.components import connected
from quaymark.llm.shared import discard, lean, packed, pieces_of, written

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
STEPS = (16, 32, 48, 64, 96, 128, 160)
TOLERANCE = 1e-6
#: Nodes in a block, and shingles in a block, at most (a node alone may have more).
BLOCK, BLOCK_SHINGLES = 256, 2_000_000
#: Rows of two numbers that are sent to all tasks at most; more are joined by a shuffle.
MOST_SENT = 200_000
#: The same for rows with a sketch (320 bytes).
MOST_SKETCHES = 10_000

_MULTIPLIERS = K.mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_ADDENDS = K.mix(np.arange(1, HASHES + 1, dtype=np.uint64) << np.uint64(20))


def least_matches(threshold: float, tolerance: float, steps: tuple[int, ...] = STEPS) -> list[int]:
    """For each step, the least matches at which the posterior still reaches the tolerance.

    With a uniform prior, m matches among n leave P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in steps:
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def distinct_shingles(column: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct shingles of each text, bounds by text)."""
    grams, bounds = K.shingles(*K.buffer_of(column), n)
    sets = [np.unique(grams[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def fingerprints(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows of 16 bytes, one for each non-empty set."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, 2), dtype=">u8")
    if len(full):
        out[full, 0] = K.mix(np.add.reduceat(K.mix(sets ^ np.uint64(0x5851F42D4C957F2D)), bounds[full]))
        out[full, 1] = np.add.reduceat(sets, bounds[full])
    return out


def sketches(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """HASHES 16-bit values per set (rows of zeros for empty sets)."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, HASHES), dtype="<u2")
    if len(full):
        with np.errstate(over="ignore"):
            for k in range(HASHES):
                out[full, k] = np.minimum.reduceat(sets * _MULTIPLIERS[k] + _ADDENDS[k], bounds[full]) >> np.uint64(16) & np.uint64(0xFFFF)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _rows(column: pa.Array, dtype: str) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype=dtype).reshape(len(column), -1)


def text_key(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def described(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, fingerprint of the set (null without shingles), n_set, sketch of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch):
                sets, bounds = distinct_shingles(part.column("text"), n)
                size = np.diff(bounds)
                none = pa.array(size == 0)
                node, sketch = (pa.compute.if_else(none, pa.scalar(None, pa.binary()), _binary(x)) for x in (fingerprints(sets, bounds), sketches(sets, bounds)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), node, pa.array(size), sketch], names=["doc_id", "text_key", "fingerprint", "n_set", "sketch"])

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key(F.col("text")).alias("text_key"))
    return held.mapInArrow(lean(run), "doc_id long, text_key long, fingerprint binary, n_set long, sketch binary")


def representatives(rows: DataFrame) -> DataFrame:
    """node, fingerprint, copies, n_set, sketch, and its least document (known, doc_id, text_key in one struct), written so that the nodes' numbers stay."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key")).alias("first")
    sets = rows.where(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"), F.max("n_set").alias("n_set"), F.max("sketch").alias("sketch"), first)
    return written(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")


def bands(reps: DataFrame) -> DataFrame:
    """key, node for each band of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                held = _rows(batch.column("sketch"), "<u2").reshape(-1, BANDS, ROWS).astype(np.uint64)
                with np.errstate(over="ignore"):
                    key = K.mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :].repeat(len(held), axis=0)
                    for r in range(ROWS):
                        key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + held[:, :, r])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(np.repeat(batch.column("node").to_numpy(), BANDS))], names=["key", "node"])

    return reps.select("node", "sketch").mapInArrow(lean(run), "key long, node long")


def unpruned(sketch: np.ndarray, a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Which of the pairs a[i], b[i] of rows of sketches survive all steps."""
    live = np.arange(len(a))
    matches = np.zeros(len(a), dtype=np.int16)
    done = 0
    for n, m in zip(STEPS, least, strict=True):
        matches = matches + (sketch[a[live], done:n] == sketch[b[live], done:n]).sum(axis=1, dtype=np.int16)
        stay = matches >= m
        live, matches, done = live[stay], matches[stay], n
    return live


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n items is connected to."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            cut[1:] |= c[1:] != c[:-1]
        at = [0, *np.flatnonzero(cut).tolist(), batch.num_rows]
        for i, j in zip(at, at[1:]):
            key = tuple(c[i] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def one_batch(table: pa.Table) -> pa.RecordBatch:
    """All rows of a table as one batch, whatever its size: binary columns with 64-bit offsets."""
    wide = pa.schema([pa.field(f.name, pa.large_binary()) if pa.types.is_binary(f.type) else f for f in table.schema])
    batches = table.cast(wide).combine_chunks().to_batches()
    if len(batches) != 1:
        raise ValueError(f"{len(batches)} batches of a table in one chunk")
    return batches[0]


def _pairs_within(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _survivors(sketch: np.ndarray, a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """``unpruned`` for any number of pairs."""
    return np.concatenate([np.zeros(0, np.int64), *(lo + unpruned(sketch, a[lo : lo + 50_000], b[lo : lo + 50_000], least) for lo in range(0, len(a), 50_000))])


def _star(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Edges a, b from each node to the least one that it is connected to, by the pairs of places a and b in ``node``, where one may occur again."""
    distinct, own = np.unique(node, return_inverse=True)
    label = stars(len(distinct), own[a], own[b])
    moved = np.flatnonzero(label != np.arange(len(distinct)))
    return pa.RecordBatch.from_arrays([pa.array(distinct[moved]), pa.array(distinct[label[moved]])], names=["a", "b"])


def _sent(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def candidates(reps: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """a, b: edges whose components hold every pair of nodes that may be linked."""
    least = least_matches(threshold, tolerance)
    keyed = bands(reps)
    shared = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).where("n > 1"), "buckets")
    inside = written(keyed.join(shared, "key"), "candidates")
    sketches_ = reps.select("node", "sketch")
    small = inside.where(F.col("n") <= BLOCK).select("key", "node").join(sketches_, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches):
            key = batch.column("key").to_numpy()
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(first, len(key)))
            parts = [(f + x, f + y) for f, s in zip(first.tolist(), size.tolist(), strict=True) if s > 1 for x, y in [_pairs_within(s)]]
            if not parts:
                continue
            a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
            live = _survivors(_rows(batch.column("sketch"), "<u2"), a, b, least)
            yield _star(batch.column("node").to_numpy(), a[live], b[live])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Several whole buckets at a time."""
        held, n = [], 0
        for table in runs_of(batches, ["key"]):
            held.append(table)
            n += table.num_rows
            if n >= 4096:
                yield one_batch(pa.concat_tables(held))
                held, n = [], 0
        if held:
            yield one_batch(pa.concat_tables(held))

    edges = small.repartition("key").sortWithinPartitions("key").mapInArrow(lean(run), "a long, b long")
    large = inside.where(F.col("n") > BLOCK)
    if large.isEmpty():
        out = written(edges.distinct(), "candidate-edges")
        discard(shared, inside)
        return out

    def near_least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.concatenate([_rows(batch.column("sketch"), "<u2"), _rows(batch.column("pivot"), "<u2")])
            n = batch.num_rows
            near = np.zeros(n, bool)
            near[_survivors(both, np.arange(n), n + np.arange(n), least)] = True
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "node", "least", "n")), pa.array(near)], names=["key", "node", "least", "n", "near"])

    pivots = sketches_.join(_sent(shared.where(F.col("n") > BLOCK).select(F.col("least").alias("node")).distinct()), "node", "left_semi")
    held = large.join(sketches_, "node").join(_sent(pivots.select(F.col("node").alias("least"), F.col("sketch").alias("pivot")), MOST_SKETCHES), "least")
    first = written(held.select("key", "node", "least", "n", "sketch", "pivot").mapInArrow(lean(near_least), "key long, node long, least long, n long, near boolean"), "large-buckets")
    edges = edges.unionByName(first.where(F.col("near") & (F.col("node") != F.col("least"))).select(F.col("node").alias("a"), F.col("least").alias("b")))
    far = first.where(~F.col("near"))
    if not far.isEmpty():
        edges = edges.unionByName(_far_edges(first, far, sketches_, least))
    out = written(edges.distinct(), "candidate-edges")
    discard(shared, inside, first)
    return out


def _far_edges(bucket: DataFrame, far: DataFrame, sketches_: DataFrame, least: list[int]) -> DataFrame:
    """a, b: stars of the surviving pairs of which one node at least is in ``far``. Blocks of those meet blocks of all nodes."""
    of = lambda n: F.ceil(n / BLOCK).cast("int")
    counts = far.groupBy("key").agg(of(F.count(F.lit(1))).alias("asked"))
    rows = bucket.join(counts, "key").select("key", "node", "near", "asked", of(F.col("n")).alias("blocks")).join(sketches_, "node")
    mine = F.xxhash64("node")
    both = lambda asking, i, j: F.struct(F.lit(asking).alias("asking"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    as_member = F.transform(F.sequence(F.lit(0), F.col("asked") - 1), lambda i: both(False, i, F.pmod(mine, F.col("blocks"))))
    as_asked = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: both(True, F.pmod(mine, F.col("asked")), j))
    dealt = rows.select("key", "node", "sketch", F.explode(F.when(F.col("near"), as_member).otherwise(F.concat(as_member, as_asked))).alias("at")).select("key", "at.i", "at.j", "at.asking", "node", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches, ["key", "i", "j"]):
            t = one_batch(table)
            asking = t.column("asking").to_numpy(zero_copy_only=False)
            x, y = np.flatnonzero(asking), np.flatnonzero(~asking)
            a, b = np.repeat(x, len(y)), np.tile(y, len(x))
            node = t.column("node").to_numpy()
            live = _survivors(_rows(t.column("sketch"), "<u2"), a, b, least)
            yield _star(node, a[live], b[live])

    keys = ["key", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(run), "a long, b long")


def shingle_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """node, shingles of the nodes in ``wanted`` (node, doc_id, text_key), from their first documents' texts."""
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    mine = _sent(wanted.select("node", F.col("doc_id").alias("id_"), F.col("text_key").alias("key_")))
    rows = held.join(mine, (text_key(F.col("text")) == F.col("key_")) & F.col("doc_id").eqNullSafe(F.col("id_"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch):
                sets, bounds = distinct_shingles(part.column("text"), n)
                offsets = pa.py_buffer((bounds * 8).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(sets))])], names=["node", "shingles"])

    # Repeated rows give a node twice.
    return rows.mapInArrow(lean(run), "node long, shingles binary").groupBy("node").agg(F.max("shingles").alias("shingles"))


def intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common shingles of the pairs a[i], b[i]."""
    if len(a) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    distinct, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for lo in range(0, len(distinct), 4096):
        i, j = np.searchsorted(code, [lo, lo + 4096])
        has = np.zeros((len(sets), 4096), dtype=np.float32)
        has[owner[i:j], code[i:j] - lo] = 1
        total += has @ has.T
    return total[a, b].astype(np.int64)


def meetings(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """component, left, right, side, node: which nodes' sets meet in which pair of blocks.

    members: component, block, blocks, node, n_set, sketch. A component of one block meets whole; of larger ones, those nodes
    that have a partner there by size and sketch.
    """
    least = least_matches(threshold, tolerance)
    alone = members.where("blocks = 1").select("component", F.lit(0).alias("left"), F.lit(0).alias("right"), F.lit(0).alias("side"), "node")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = members.where("blocks > 1").withColumn("other", other).select("component", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), F.col("block").alias("side"), "node", "n_set", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches, ["component", "left", "right"]):
            t = one_batch(table)
            a, b = _fitting(t.column("side").to_numpy(), t.column("n_set").to_numpy(), t.column("left")[0] != t.column("right")[0], threshold)
            live = _survivors(_rows(t.column("sketch"), "<u2"), a, b, least)
            some = pa.array(np.unique(np.concatenate([a[live], b[live]])))
            yield pa.RecordBatch.from_arrays([t.column(c).take(some) for c in ("component", "left", "right", "side", "node")], names=["component", "left", "right", "side", "node"])

    keys = ["component", "left", "right"]
    kind = "component long, left int, right int, side int, node long"
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(run), kind).unionByName(alone)


def _fitting(side: np.ndarray, size: np.ndarray, across: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a task whose sizes do not rule out the threshold: within a block, or between the two sides."""
    a, b = _pairs_within(len(size))
    fit = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
    if across:
        fit &= side[a] != side[b]
    return a[fit], b[fit]


def verified(met: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """node, links, least: for each task's nodes, their linked documents there and the least node they are connected to.

    met: component, left, right, side, node, copies, sketch, shingles.
    """
    least = least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches, ["component", "left", "right"]):
            t = one_batch(table)
            sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
            size = np.array([len(s) for s in sets])
            a, b = _fitting(t.column("side").to_numpy(), size, t.column("left")[0] != t.column("right")[0], threshold)
            live = _survivors(_rows(t.column("sketch"), "<u2"), a, b, least)
            a, b = a[live], b[live]
            if len(a):
                common = intersections(sets, a, b)
                linked = common >= threshold * (size[a] + size[b] - common) - 1e-9
                a, b = a[linked], b[linked]
            copies, node, n = t.column("copies").to_numpy(), t.column("node").to_numpy(), t.num_rows
            links = np.bincount(a, weights=copies[b], minlength=n) + np.bincount(b, weights=copies[a], minlength=n)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links.astype(np.int64)), pa.array(node[stars(n, a, b)])], names=["node", "links", "least"])

    keys = ["component", "left", "right"]
    return met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(run), "node long, links long, least long")


def linked(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """(described documents; fingerprint, links, copies, first of every node, where first is its class's least document)."""
    rows = written(described(docs, n), "described")
    reps = representatives(rows)
    components = connected(candidates(reps, threshold, tolerance)).withColumnRenamed("label", "component")
    chosen = written(components.join(reps, "node"), "members")
    sizes = chosen.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_set").alias("shingles_"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles_") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    wanted = chosen.select("node", "first.doc_id", "first.text_key")
    members = chosen.join(sizes.select("component", blocks), "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = meetings(members, threshold, tolerance).join(chosen.select("node", "copies", "sketch"), "node").join(shingle_sets(docs, wanted, n), "node")
    checked = written(verified(met, threshold, tolerance), "links")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected(checked.select(F.col("node").alias("a"), F.col("least").alias("b")))
    full = reps.select("node", "fingerprint", "copies", "first").join(links, "node", "left").join(classes, "node", "left").withColumn("label", F.coalesce("label", "node"))
    full = written(full.select("fingerprint", "copies", "first", F.coalesce("links", F.lit(0)).alias("links"), "label"), "classes")
    discard(chosen, checked)
    firsts = full.groupBy("label").agg(F.min("first").alias("first"))
    return rows, written(full.drop("first").join(firsts, "label").select("fingerprint", "links", "copies", "first"), "classes")


def join(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, class_id, n_links for every document."""
    rows, found = linked(docs, n, threshold, tolerance)
    both = rows.select("doc_id", "fingerprint").join(found, "fingerprint", "left")
    alone = F.col("first").isNull()
    return both.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"), F.when(alone, F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).alias("n_links"))


def one_of_each(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The documents, all columns, of which each class keeps its least one."""
    rows, found = linked(docs, n, threshold, tolerance)
    both = rows.select("doc_id", "text_key", "fingerprint").join(found.select("fingerprint", "first"), "fingerprint")
    mine = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    # Rows to go, and the classes' first documents where the same row occurs again.
    counted = both.groupBy("doc_id", "text_key").agg(F.bool_or(mine).alias("stays"), F.count(F.lit(1)).alias("n"))
    odd = written(counted.where(~F.col("stays") | (F.col("n") > 1)).select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_"), "stays"), "gone")
    sent = F.broadcast(odd) if odd.count() <= MOST_SENT else odd
    whole = packed(docs)
    marked = whole.join(sent, F.col("row_.doc_id").cast("long").eqNullSafe(F.col("id_")) & (text_key(F.col("row_.text")) == F.col("key_")), "left")
    once = marked.where("stays").dropDuplicates(["id_", "key_"])
    return marked.where(F.col("stays").isNull()).select("row_.*").unionByName(once.select("row_.*"))
