"""Mixing sources to target weights by histograms over hash thresholds.

Every document has a 48-bit hash of its doc_id and text. A source's budget is met by the documents whose hash lies below
the source's threshold, so a larger budget takes a superset. The threshold is found without sorting: sizes are summed by
source and leading hash bits, the running sum tells the bucket in which the budget ends, and only the documents of that
bucket are summed again by their next bits, until a bucket is one hash value, the edge. The words that the document at the
edge would exceed are given, in the same way, to documents behind it that are small enough, in ROUNDS rounds at most; a source
has another one while more than MISSING of its target is missing. The last round's edge document is in if that comes nearer to the target. Where much is still missing then (all small documents are in
already), that document is taken and small ones, found by a threshold in the same way, are left out for what it exceeds, if
that comes nearer. What is kept then is a filter.

Sizes are words, ``[^\\x20\\x09-\\x0D]+``. Weights repeat over the sources in code-point order, null last. A target is
the source's share of all sizes, at most ``cap`` times the source's size; the excess goes to the others by weight until
none is above. A source takes each document floor(target / size) times, and those that the thresholds choose once more.
Taken words differ from the target by half the size of the last edge's document at most.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own; null doc_ids are told apart by
their texts; rows with equal doc_id and text share one hash, so they are taken together; an empty table gives no rows. If
all sizes are 0, all targets are 0. Other columns are kept by ``mixed`` and not read by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.llm.shared import discard, packed, written

#: A hash has BITS; each level of buckets shows it without its last bits. The last level tells single values apart, among what is left of a source's 2**24 buckets.
BITS, SHIFTS = 48, (36, 24, 0)
#: Thresholds per source: what the first one leaves of a budget is filled with later documents that are small enough.
ROUNDS = 4
#: Share of a target that may be missing without another round, or a look at documents to leave out.
MISSING = 0.001
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("long"), F.xxhash64(text.cast("string"))), F.lit(1 << BITS))


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df with ``nth`` from 0 in this order, without a task that sees all rows: ranks within ranges plus the ranges' counts."""
    held = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id()), "numbered")
    task = F.shiftright("at_", 33)
    counts = sorted((r["task"], r["n"]) for r in held.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row per task
    first, n = [], 0
    for t, k in counts:
        first.append((t, n))
        n += k
    base = df.sparkSession.createDataFrame(first, "task_ long, first_ long")
    return held.join(base, task == F.col("task_")).withColumn("nth", F.col("first_") + F.col("at_").bitwiseAND(F.lit((1 << 33) - 1))).drop("at_", "task_", "first_")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """source, source_size, target from rows source, size (one per source)."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    held = written(numbered(sizes.select("source", F.col("size").alias("source_size")), F.col("source").asc_nulls_last()).select("source", "source_size", weight.alias("weight")), "sources")
    total = held.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    most, level, stopped = cap * F.col("source_size"), 0.0, -1
    while True:  # each round stops one source more at least
        over = F.col("weight") * level > most if stopped >= 0 else F.lit(False)
        row = held.agg(F.count_if(over).alias("n"), F.sum(F.when(over, most).otherwise(0.0)).alias("given"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("left")).first()
        if row["n"] == stopped or not row["left"]:
            break
        stopped, level = row["n"], max(0.0, total - row["given"]) / row["left"]
    return held.select("source", "source_size", F.least(F.col("weight") * F.lit(level), most).alias("target"))


def thresholds(slim: DataFrame, goals: DataFrame) -> DataFrame:
    """source, source_size, target, times, and what ``times_taken`` compares a document with: a row per source."""
    whole = F.col("source_size") > 0
    times = F.when(whole, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.when(whole, F.col("target") - F.col("times") * F.col("source_size")).otherwise(0.0)
    none = F.lit(None).cast("long")
    out = written(goals.withColumn("times", times).withColumns({"left0": left, "from0": F.lit(0).cast("long"), "rest": left, "edge": none, "edge_size": none}), "goals")
    for k in range(ROUNDS):
        state = out.select("source", F.col(f"left{k}").alias("left"), F.col(f"from{k}").alias("from")).where(F.col("left").isNotNull())
        if state.isEmpty():
            nothing = {f"{n}{i}": none for i in range(k, ROUNDS) for n in ("left", "from", "below")}
            out = out.withColumns(nothing)
            break
        small = F.lit(True) if k == 0 else F.col("size") <= F.col("left")
        found = _edge(_of(slim, state, (F.col("hash") >= F.col("from")) & small), state)
        joined = out.join(found.select(F.col("source").alias("s_"), F.col("hash").alias("hash_"), F.col("size").alias("size_"), F.col("rest").alias("rest_")), out["source"].eqNullSafe(F.col("s_")), "left")
        # Without an edge all that is left of the source fits.
        below = F.when(F.col("hash_").isNotNull(), F.col("hash_")).when(F.col(f"left{k}").isNotNull(), F.lit(1 << BITS)).otherwise(F.lit(0)).alias(f"below{k}")
        later = [F.coalesce("rest_", "rest").alias("rest"), F.coalesce("hash_", "edge").alias("edge"), F.coalesce("size_", "edge_size").alias("edge_size")]
        kept = [c for c in out.columns if c not in ("rest", "edge", "edge_size")]
        old, out = out, written(joined.select(*kept, below, (F.col("hash_") + 1).alias(f"from{k + 1}"), F.when(F.col("hash_").isNotNull() & (F.col("rest_") > MISSING * F.col("target")), F.col("rest_")).alias(f"left{k + 1}"), *later), "thresholds")
        discard(found, old)
    return _settled(slim, out)


def _settled(slim: DataFrame, out: DataFrame) -> DataFrame:
    """thresholds with the decision on the last edge's document, and what is left out to make room for it."""
    over = F.col("edge_size") - F.col("rest")
    out = out.withColumn("over", over)
    state = out.where(F.col("edge").isNotNull() & (F.least("rest", "over") > MISSING * F.col("target")))
    plain = F.least(F.col("rest"), F.coalesce("over", "rest"))
    named = {"drop_below": F.col("hash"), "drop_edge": F.col("hash"), "drop_size": F.col("size"), "drop_rest": F.col("rest")}
    if state.isEmpty():
        found = out.limit(0).select("source", F.col("edge").alias("hash"), F.col("edge_size").alias("size"), "rest")
    else:
        found = _edge(_of(slim, state, _inside(F.col("hash"), F.col("size")) & (F.col("size") <= F.col("over")) & (F.col("hash") != F.col("edge"))), state.select("source", F.col("over").alias("left")))
    drops = found.select(F.col("source").alias("s_"), *[c.alias(n) for n, c in named.items()])
    both = out.join(drops, out["source"].eqNullSafe(F.col("s_")), "left")
    edge_too = F.coalesce(2 * F.col("drop_rest") >= F.col("drop_size"), F.lit(False))
    error = F.when(edge_too, F.col("drop_size") - F.col("drop_rest")).otherwise(F.col("drop_rest"))
    swap = F.coalesce(error < plain, F.lit(False))
    taken = swap | F.coalesce(2 * F.col("rest") >= F.col("edge_size"), F.lit(False))
    return written(
        both.select(
            "source", "source_size", "target", "times", *[f"{n}{k}" for k in range(ROUNDS) for n in ("left", "from", "below")], F.when(taken, F.col("edge")).alias("edge"),
            F.when(swap, F.coalesce("drop_below", F.lit(1 << BITS))).alias("drop_below"), F.when(swap & edge_too, F.col("drop_edge")).alias("drop_edge"), F.when(swap, F.col("over")).alias("drop_most"),
        ),
        "thresholds",
    )


def _of(slim: DataFrame, state: DataFrame, test: Column) -> DataFrame:
    """source, hash, size of the documents that pass a test, which may read their source's row of ``state``."""
    held = state.withColumnRenamed("source", "s_")
    return slim.join(held, slim["source"].eqNullSafe(F.col("s_")) & test).select("source", "hash", "size")


def _edge(rows: DataFrame, state: DataFrame) -> DataFrame:
    """source, hash, size, rest for each source of ``state`` (source, left): the hash at which its rows' running size exceeds the budget, and what the rows before it leave; without such a hash, what all its rows leave."""
    at, out = state.select("source", F.col("left").cast("double").alias("left"), F.lit(0).cast("long").alias("bucket")), None
    used = []
    for above, shift in zip((BITS, *SHIFTS), SHIFTS, strict=False):
        held = at.select(F.col("source").alias("s_"), "left", "bucket")
        inside = rows.join(held, rows["source"].eqNullSafe(F.col("s_")) & (F.shiftright("hash", above) == F.col("bucket")))
        sums = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket"), "left").agg(F.sum("size").alias("size"))
        w = Window.partitionBy("source").orderBy("bucket")
        upto = sums.withColumns({"upto": F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)), "last": F.lead("bucket").over(w).isNull()})
        ends = (F.col("upto") > F.col("left")) & (F.col("upto") - F.col("size") <= F.col("left"))
        edge = written(upto.where(ends | (F.col("last") & (F.col("upto") <= F.col("left")))).select("source", "bucket", "size", (F.col("left") - F.col("upto")).alias("rest")), "edges")
        used.append(edge)
        if out is None:
            out = edge.where("rest >= 0").select("source", F.lit(None).cast("long").alias("hash"), F.lit(None).cast("long").alias("size"), "rest")
        at = edge.where("rest < 0").select("source", (F.col("rest") + F.col("size")).alias("left"), "bucket", "size")
    found = written(out.unionByName(at.select("source", F.col("bucket").alias("hash"), "size", F.col("left").alias("rest"))), "edges")
    discard(*used)
    return found


def _inside(hashed: Column, size: Column) -> Column:
    """Whether a document is chosen by its source's rounds, by the columns left0.. below3."""
    more = hashed < F.col("below0")
    for k in range(1, ROUNDS):
        more = more | ((hashed >= F.col(f"from{k}")) & (hashed < F.col(f"below{k}")) & (size <= F.col(f"left{k}")))
    return F.coalesce(more, F.lit(False))


def times_taken(hashed: Column, size: Column) -> Column:
    """How often a document is taken, beside its source's row of thresholds."""
    edge = F.coalesce(hashed == F.col("edge"), F.lit(False))
    dropped = F.coalesce(((hashed < F.col("drop_below")) & (size <= F.col("drop_most"))) | (hashed == F.col("drop_edge")), F.lit(False))
    return F.col("times") + ((_inside(hashed, size) & ~dropped) | edge).cast("long")


def _measured(docs: DataFrame) -> DataFrame:
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id"), F.col("text")).alias("hash")]
    return written(docs.select(*columns), "sizes")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    slim = _measured(docs)
    found = thresholds(slim, targets(slim.groupBy("source").agg(F.sum("size").alias("size")), weights, cap)).withColumnRenamed("source", "s_")
    taken = F.col("size") * times_taken(F.col("hash"), F.col("size"))
    return slim.join(found, slim["source"].eqNullSafe(F.col("s_"))).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with all their columns."""
    slim = _measured(docs)
    found = thresholds(slim, targets(slim.groupBy("source").agg(F.sum("size").alias("size")), weights, cap))
    rows = packed(docs).withColumn("hash_", hash_of(F.col("row_.doc_id"), F.col("row_.text"))).withColumn("size_", size_of(F.col("row_.text")))
    joined = rows.join(found, F.col("row_.source").cast("string").eqNullSafe(found["source"]))
    return joined.select("row_", F.explode(F.array_repeat(F.lit(0), times_taken(F.col("hash_"), F.col("size_")).cast("int"))).alias("again_")).select("row_.*")
