"""Quality rules with a robust multivariate outlier test.

Base statistics come from every whole text; a document with fewer than 20 words, or with more than 30 % of its words in
repeated 8-word windows, fails the base rules. For the others, transformed statistics are held against their language's
and source's minimum-covariance-determinant estimate: the mean and covariance of the documents that lie closest together, three
quarters of each language by their distances within their own sources. The estimate starts from the language's medians and
median deviations and is improved by concentration steps until means rest; in each, documents are binned by their Mahalanobis
distance and the moments are summed per bin, so one aggregation over all documents gives both the quantile and the next
estimate, and no group is gathered or sampled.

Every group is judged by an estimate of its own, whatever its size: its moments are added to those of its language with the
weight of ``prior`` documents, and a language's to the whole corpus's in the same way. So a source of millions has its own
estimate in effect, one of three documents its language's, and there is no size at which the rule changes. The weight also keeps
an outlier of a small group from hiding behind the spread that it makes itself: alone it counts one in a hundred.

Moments are sums of whole numbers (statistics in steps of 2**-20), so reruns give the same verdicts whatever the order.

Defined results: a null text has no words and fails the base rules; null language or source is a group value of its own; null
doc_ids stay null; ties lie in one bin, so they are taken together; repeated rows count as often as they occur; an empty
table gives no rows; other columns are not read. A word is ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.llm import textkernel as K
from quaymark.llm.shared import discard, lean, pieces_of, written

SYMBOLS = b"#*$%&|<>"
WINDOW, MIN_WORDS, MOST_REPEATED = 8, 20, 30
#: Share of documents in the estimate; tail beyond which a document is rejected; documents that the language weighs for a source.
SHARE, TAIL, PRIOR = 0.75, 1e-4, 200
#: Concentration steps at most, and the part of a floor that no mean moves any more at the last one.
STEPS, REST = 10, 0.02
#: Standard deviations below which no statistic is taken to vary, for n_words, word length, symbols, repeats and repeated lines.
FLOORS = (0.5, 0.15, 0.6, 0.8, 0.5)
P = len(FLOORS)
#: Bins of the logarithm of a distance, and of a statistic for medians; steps of what is summed.
BIN, STAT_BIN, UNIT = 0.02, 0.02, 2.0**-20
#: Groups whose estimates (26 numbers each) are sent to all tasks, so a source of many documents is not dealt to one; those of more groups are joined by a shuffle.
MOST_SENT = 20_000
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
MOMENTS = ["n", *(f"s{i}" for i in range(P)), *(f"x{i}{j}" for i, j in PAIRS)]

STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def base_statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The base statistics of each text."""
    data, offsets = K.buffer_of(column)
    n = len(offsets) - 1
    starts, ends, bounds = K.words(data, offsets)
    marks = np.zeros(256, dtype=bool)
    marks[list(SYMBOLS)] = True
    per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    word_chars = per(~K.IS_SPACE[data] & ((data & 0xC0) != 0x80))
    n_symbols = per(marks[data])
    # lines with a word that an earlier line of the text equals
    first, last, by_line = K.lines(data, offsets)
    solid = np.concatenate([[0], np.cumsum(~K.IS_SPACE[data])])
    full = solid[last] > solid[first]
    doc = K.per_text(by_line)[full]
    hashed = K.segment_hashes(data, first[full], last[full])
    order = np.lexsort((hashed, doc))
    doc, hashed = doc[order], hashed[order]
    again = np.zeros(len(doc), dtype=bool)
    again[1:] = (doc[1:] == doc[:-1]) & (hashed[1:] == hashed[:-1])
    n_dup_lines = np.bincount(doc[again], minlength=n)
    # words in windows that the text has twice or more
    grams, at = K.gram_hashes(K.segment_hashes(data, starts, ends), bounds, WINDOW)
    doc = K.per_text(at)
    mixed = K.mix(grams + K.mix(doc.astype(np.uint64)))
    order = np.argsort(mixed, kind="stable")
    ranked = mixed[order]
    same = np.zeros(len(ranked) + 1, dtype=bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    repeated = order[same[1:] | same[:-1]]
    place = bounds[doc[repeated]] + repeated - at[doc[repeated]]
    cover = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + WINDOW, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return {"n_words": np.diff(bounds), "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": np.diff(inside[bounds])}


def statistics(docs: DataFrame) -> DataFrame:
    """The base statistics of all documents, with base_failed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch):
                found = base_statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(v.astype(np.int64)) for v in found.values())], names=["doc_id", "lang", "source", *found])

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return held.mapInArrow(lean(run), STATS).withColumn("base_failed", failed)


def vector() -> list[Column]:
    """The transformed statistics. Documents without words are not tested; they must not divide by zero either."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p(F.col("n_words").cast("double")),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log1p(100.0 * F.col("n_symbols") / n),
        F.log1p(100.0 * F.col("n_repeat_words") / n),
        F.log1p(100.0 * F.col("n_dup_lines") / n),
    ]


def gamma_share(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1.0 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi_square_quantile(share: float, freedom: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_share(freedom / 2, mid / 2) < share else (low, mid)
    return high


def consistency(share: float = SHARE, freedom: int = P) -> float:
    """What makes the covariance of the closest share right for normal data."""
    return share / gamma_share(freedom / 2 + 1, chi_square_quantile(share, freedom) / 2)


def _estimates(sums: DataFrame, scale: float) -> DataFrame:
    """key, m0.. (means) and w0.. (the upper triangle of the inverse covariance) from counts and summed moments, a row per group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = lambda c: b.column(c).to_numpy(zero_copy_only=False).astype(float)
            n = np.maximum(column("n"), 1e-9)
            mean = np.stack([column(f"s{i}") * UNIT / n for i in range(P)], axis=1)
            cov = np.zeros((len(n), P, P))
            for i, j in PAIRS:
                cov[:, i, j] = cov[:, j, i] = scale * (column(f"x{i}{j}") * UNIT / n - mean[:, i] * mean[:, j])
            lift = np.maximum(np.square(FLOORS) - np.diagonal(cov, axis1=1, axis2=2), 0)
            inverse = np.linalg.inv(cov + np.eye(P) * lift[:, None, :])
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(mean[:, i]) for i in range(P)), *(pa.array(inverse[:, i, j]) for i, j in PAIRS)], names=["key", *(f"m{i}" for i in range(P)), *(f"w{i}{j}" for i, j in PAIRS)])

    kind = ", ".join(["key string", *(f"m{i} double" for i in range(P)), *(f"w{i}{j} double" for i, j in PAIRS)])
    return written(sums.select("key", *MOMENTS).mapInArrow(lean(run), kind), "estimates")


def distance() -> Column:
    """The squared Mahalanobis distance of v0.. from m0.. under w0..."""
    d = [F.col(f"v{i}") - F.col(f"m{i}") for i in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(i, P):
            total = total + (1.0 if i == j else 2.0) * d[i] * d[j] * F.col(f"w{i}{j}")
    return F.greatest(total, F.lit(0.0))


def _moments() -> list[Column]:
    whole = lambda c: F.sum(F.round(c / UNIT).cast("long"))
    out = [F.count(F.lit(1)).alias("n"), *(whole(F.col(f"v{i}")).alias(f"s{i}") for i in range(P))]
    return [*out, *(whole(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"x{i}{j}") for i, j in PAIRS)]


def _start(points: DataFrame, sent: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """First estimates of the languages: medians and scaled median deviations, from histograms."""

    def middle(rows: DataFrame, value: Column) -> DataFrame:
        """language, i, mid: the middle of the bin where each statistic's median lies."""
        cells = rows.groupBy("language", "i", F.floor(value / STAT_BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("language", "i")
        upto = cells.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
        edge = upto.where((2 * F.col("upto") >= F.col("all")) & (2 * (F.col("upto") - F.col("n")) < F.col("all")))
        return written(edge.select("language", "i", ((F.col("bin") + 0.5) * STAT_BIN).alias("mid")), "medians")

    long = points.select("language", F.posexplode(F.array(*[f"v{i}" for i in range(P)])).alias("i", "v"))
    centre = middle(long, F.col("v"))
    spread = middle(long.join(sent(centre), ["language", "i"]), F.abs(F.col("v") - F.col("mid")))
    both = centre.join(spread.withColumnRenamed("mid", "dev"), ["language", "i"]).groupBy("language")
    wide = both.agg(*[F.max(F.when(F.col("i") == i, F.col("mid"))).alias(f"m{i}") for i in range(P)], *[F.max(F.when(F.col("i") == i, F.col("dev"))).alias(f"d{i}") for i in range(P)])
    variance = lambda i: F.greatest(F.pow(1.4826 * F.col(f"d{i}"), F.lit(2.0)), F.lit(FLOORS[i] ** 2))
    weights = [(1.0 / variance(i) if i == j else F.lit(0.0)).alias(f"w{i}{j}") for i, j in PAIRS]
    out = written(wide.select("language", *[f"m{i}" for i in range(P)], *weights), "estimates")
    discard(centre, spread)
    return out


def _pooled(sums: DataFrame, groups: DataFrame, prior: float) -> DataFrame:
    """key and moments of each group, with its language's at the weight of ``prior`` documents, and that with the corpus's."""
    total = lambda rows, tag: rows.agg(*[F.sum(c).alias(f"{tag}{c}") for c in MOMENTS])
    corpus, languages = total(sums, "c_"), total(sums.groupBy("language"), "l_")
    # The corpus is one row, and languages are few.
    held = groups.join(sums.drop("language"), "key", "left").join(languages, "language", "left").join(F.broadcast(corpus), F.lit(True))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    of_corpus = lambda c: zero(f"c_{c}") / F.greatest(zero("c_n"), F.lit(1.0))
    of_language = lambda c: (zero(f"l_{c}") + prior * of_corpus(c)) / (zero("l_n") + prior)
    return held.select("key", *[((zero(c) + prior * of_language(c)) if c != "n" else zero("n") + prior).alias(c) for c in MOMENTS])


def judge(stats: DataFrame, share: float = SHARE, steps: int = STEPS, prior: float = PRIOR, tail: float = TAIL) -> DataFrame:
    """stats with ``distance`` (null: fails the base rules) and ``kept``."""
    # Groups are named by escaped, joined values, so null and text cannot be taken for each other.
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    language = name("lang")
    key = F.concat_ws("\x1f", language, name("source"))
    vectors = [v.alias(f"v{i}") for i, v in enumerate(vector())]
    points = written(stats.where(~F.col("base_failed")).select(language.alias("language"), key.alias("key"), *vectors), "points")
    groups = written(points.select("language", "key").distinct(), "groups")
    few = groups.count() <= MOST_SENT
    sent = lambda small: F.broadcast(small) if few else small
    scale, first = consistency(share), _start(points, sent)
    estimate = written(groups.join(first, "language").drop("language"), "estimates")
    for _ in range(steps):
        bins = written(points.join(sent(estimate), "key").withColumn("bin", F.floor(F.log(distance() + 1e-9) / BIN)).groupBy("language", "key", "bin").agg(*_moments()), "bins")
        w = Window.partitionBy("language").orderBy("bin")
        upto = bins.groupBy("language", "bin").agg(F.sum("n").alias("n")).withColumns({"below": F.sum("n").over(w) - F.col("n"), "all": F.sum("n").over(Window.partitionBy("language"))})
        closest = bins.join(upto.where(F.col("below") < F.ceil(share * F.col("all"))).select("language", "bin"), ["language", "bin"])
        sums = written(closest.groupBy("language", "key").agg(*[F.sum(c).alias(c) for c in MOMENTS]), "sums")
        new = _estimates(_pooled(sums, groups, prior), scale)
        moved = F.greatest(*[F.abs(F.col(f"a.m{i}") - F.col(f"b.m{i}")) / FLOORS[i] for i in range(P)])
        rests = (new.alias("a").join(estimate.alias("b"), "key").agg(F.max(moved).alias("m")).first()["m"] or 0.0) <= REST
        discard(bins, sums, estimate)
        estimate = new
        if rests:
            break
    discard(points, groups, first)
    own = F.when(~F.col("base_failed"), key)
    joined = stats.withColumn("key_", own).join(sent(estimate), F.col("key_") == F.col("key"), "left")
    far = joined.select(*[F.col(c) for c in stats.columns], *vectors, *[c for c in estimate.columns if c != "key"]).withColumn("distance", F.when(F.col("m0").isNotNull(), distance()))
    kept = ~F.col("base_failed") & (F.col("distance") <= chi_square_quantile(1 - tail, P))
    return far.select(*stats.columns, "distance", F.coalesce(kept, F.lit(False)).alias("kept"))


def rate(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, distance and kept for every document."""
    stats = written(statistics(docs), "statistics")
    return judge(stats).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")
