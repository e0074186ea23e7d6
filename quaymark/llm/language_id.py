"""Language identification with hyperdimensional letter-trigram profiles.

Each letter has a random vector of +1 and -1, made from its code point. A trigram's vector binds its letters, each permuted by
its place (a cyclic shift), by multiplication; a text's vector bundles (sums) the vectors of its trigrams, and so does a
language's prototype over all its learning texts. A text has the language whose prototype, less the mean of all prototypes, has
the largest cosine with the text's vector less that mean's direction.

A task counts the trigrams of each language, bundles them when it ends (or holds MOST_HELD different ones), and gives one number
per language and dimension; these are summed in Spark, so the driver receives languages x DIMENSIONS numbers, whatever the corpus.

``with_language`` rejects by fit: the cosine of a text's vector with the whole prototype of its language, which chance lowers in
short texts. Per language and size (a power of two of trigrams) all documents' cosines are counted in bins of FIT_BIN; a document
goes if its cosine is less than FIT of the median there. Letters without a language, and languages that were not learned, do not
come near that; clean texts do not fall so low.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing could be learned;
equal cosines go to the lower language by code point; a null lang is not learned from; a null doc_id counts as held out;
repeated rows are learned as often as they occur; other columns are not read. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.llm import bpe
from quaymark.llm import textkernel as K
from quaymark.llm.shared import lean, packed, packed_schema, pieces_of, with_fields, written

DIMENSIONS, SEED = 1024, 20
UNDETERMINED = "und"
#: Bits of a code point in a trigram's number.
POINT = 21
#: Different trigrams that a task counts before it bundles them.
MOST_HELD = 1 << 20
#: Bins of cosines, and the part of the median of its language and size that a document's must reach.
FIT_BIN, FIT = 0.01, 0.5


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigrams as three code points in one number, bounds by text, whether it has a letter). What is no letter is 0, and one mark stands between words."""
    data, offsets = K.buffer_of(pc.utf8_lower(column.cast(pa.large_string())))
    cp, at = bpe.code_points(data)
    cut = np.searchsorted(at, offsets)
    letter = bpe.classes()[cp] == bpe.LETTER
    after = np.zeros_like(letter)
    after[1:] = letter[:-1]
    after[cut[:-1][cut[:-1] < len(cp)]] = True  # a text's first sign counts
    keep = letter | after
    held = np.where(letter, cp, 0)[keep].astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(keep)])[cut]
    n = len(held) - 2
    letters = np.concatenate([[0], np.cumsum(held > 0)])
    some = letters[bounds[1:]] > letters[bounds[:-1]]
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64), some
    grams = (held[:-2] << POINT | held[1:-1]) << POINT | held[2:]
    inside = np.ones(n, dtype=bool)
    for j in (1, 2):
        over = bounds[1:-1] - j
        inside[over[(over >= 0) & (over < n)]] = False
    return grams[inside], np.concatenate([[0], np.cumsum(np.maximum(np.diff(bounds) - 2, 0))]), some


def letter_vectors(points: np.ndarray, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """A row of +1 and -1 for each code point (0: the mark between words), the same in every process."""
    bits = K.mix(points.astype(np.uint64)[:, None] * np.uint64(dimensions) + np.arange(dimensions, dtype=np.uint64) + np.uint64(seed << 40))
    return np.where((bits >> np.uint64(17)) & np.uint64(1), 1, -1).astype(np.int8)


def bound(grams: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The vectors of trigrams, as rows."""
    mask = (1 << POINT) - 1
    points = np.stack([grams >> 2 * POINT, grams >> POINT & mask, grams & mask])
    distinct, which = np.unique(points, return_inverse=True)
    base = letter_vectors(distinct, dimensions)
    a, b, c = which.reshape(3, -1)
    return np.roll(base, 2, axis=1)[a] * np.roll(base, 1, axis=1)[b] * base[c]


def bundled(grams: np.ndarray, counts: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The sum of the trigrams' vectors, each as often as it occurs; whole numbers, so any order gives the same."""
    out = np.zeros(dimensions, np.int64)
    for lo in range(0, len(grams), 4096):
        # Halves of counts are exact in doubles, and faster than whole numbers.
        out += np.rint(counts[lo : lo + 4096].astype(float) @ bound(grams[lo : lo + 4096], dimensions).astype(float)).astype(np.int64)
    return out


class Counts:
    """How often each trigram occurs, as ascending numbers; what is new waits to be merged a few times per task."""

    def __init__(self) -> None:
        self.grams, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new: list[np.ndarray] = []

    def merge(self) -> int:
        """How many different trigrams are held."""
        if self.new:
            own, n = np.unique(np.concatenate(self.new), return_counts=True)
            self.new = []
            self.grams, which = np.unique(np.concatenate([self.grams, own]), return_inverse=True)
            self.n = np.bincount(which, weights=np.concatenate([self.n, n]), minlength=len(self.grams)).astype(np.int64)
        return len(self.grams)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def learn(docs: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes as rows) from text and lang of all rows given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, Counts] = {}
        waiting = 0

        def flushed() -> pa.RecordBatch:
            names = list(sums)
            for held in sums.values():
                held.merge()
            rows = np.stack([bundled(sums[x].grams, sums[x].n, dimensions) for x in names])
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(names, dimensions), pa.string()), pa.array(np.tile(np.arange(dimensions, dtype=np.int32), len(names))), pa.array(rows.ravel())], names=["lang", "dimension", "n"])

        for batch in batches:
            for part in pieces_of(batch):
                grams, bounds, _ = trigrams(part.column("text"))
                code = part.column("lang").dictionary_encode()
                of = np.repeat(code.indices.to_numpy(), np.diff(bounds))
                for i, name in enumerate(code.dictionary.to_pylist()):
                    sums.setdefault(name, Counts()).new.append(grams[of == i])
                waiting += len(grams)
                if waiting > MOST_HELD:
                    waiting = 0
                    if sum(held.merge() for held in sums.values()) > MOST_HELD:
                        yield flushed()
        if sums:
            yield flushed()

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    table = rows.mapInArrow(lean(run), "lang string, dimension int, n long").groupBy("lang", "dimension").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(set(table["lang"]), key=lambda s: s.encode())
    out = np.zeros((len(names), dimensions))
    out[table["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(int), table["dimension"].to_numpy(int)] = table["n"].to_numpy(float)
    return names, out


class Model:
    """Prototypes of length 1, their mean, and the scoring of batches."""

    def __init__(self, names: list[str], prototypes: np.ndarray):
        self.names, self.dimensions = names, prototypes.shape[1]
        norm = np.linalg.norm(prototypes, axis=1, keepdims=True)
        unit = prototypes / np.where(norm > 0, norm, 1)
        self.unit = unit.astype(np.float32)
        self.mean = unit.mean(axis=0) if len(names) > 1 else np.zeros(self.dimensions)
        own = unit - self.mean
        norm = np.linalg.norm(own, axis=1, keepdims=True)
        self.own = (own / np.where(norm > 0, norm, 1)).astype(np.float32)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, fit to its whole prototype, trigrams) of each text."""
        grams, bounds, some = trigrams(column)
        n, size = len(column), np.diff(bounds)
        if not self.names or not n:
            return [UNDETERMINED] * n, np.zeros(n), np.zeros(n), size
        active, which = np.unique(grams, return_inverse=True)
        vectors = np.zeros((n, self.dimensions), dtype=np.float32)
        doc = K.per_text(bounds)
        for lo in range(0, len(active), 2048):
            use = (which >= lo) & (which < lo + 2048)
            width = min(2048, len(active) - lo)
            counts = np.bincount(doc[use] * width + which[use] - lo, minlength=n * width).reshape(n, width).astype(np.float32)
            vectors += counts @ bound(active[lo : lo + width], self.dimensions).astype(np.float32)
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        unit = vectors / np.where(norm > 0, norm, 1)
        apart = unit - self.mean.astype(np.float32)
        norm = np.linalg.norm(apart, axis=1, keepdims=True)
        cosine = apart @ self.own.T / np.where(norm > 0, norm, 1)
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(n), best], 0, 1).astype(float)
        fit = (unit * self.unit[best]).sum(axis=1).astype(float)
        return [self.names[i] if ok else UNDETERMINED for i, ok in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, score, 0.0), fit, size


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """row_ (all columns of the input), lang_pred, score, fit, n_grams for every document; only texts are looked at."""
    rows = packed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(with_fields(batch, text=pa.string())):
                names, score, fit, size = model.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("row_"), pa.array(names, pa.string()), pa.array(score), pa.array(fit), pa.array(size.astype(np.int64))], names=["row_", "lang_pred", "score", "fit", "n_grams"])

    return rows.mapInArrow(lean(run), packed_schema(rows, "lang_pred string, score double, fit double, n_grams long"))


def identify(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the rows that are not held out."""
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(True))
    model = Model(*learn(docs.where(~out), dimensions))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return predicted(slim, model).select("row_.doc_id", F.coalesce(held_out(F.col("row_.doc_id")), F.lit(True)).alias("held_out"), "lang_pred", "score")


def least_fits(found: DataFrame, fit: float = FIT) -> dict[tuple[str, int], float]:
    """The least fit of each language and size that stays, from all documents: at most languages x 64 sizes x 1 / FIT_BIN counts."""
    bins = found.where(F.col("lang_pred") != UNDETERMINED).groupBy("lang_pred", size_bin().alias("size"), F.floor(F.col("fit") / FIT_BIN).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    out = {}
    for key, rows in bins.sort_values("bin").groupby(["lang_pred", "size"]):
        upto = rows["n"].cumsum().to_numpy()
        out[key[0], int(key[1])] = fit * FIT_BIN * int(rows["bin"].to_numpy()[np.searchsorted(upto, 0.5 * upto[-1])])
    return out


def size_bin() -> Column:
    return F.floor(F.log2(F.greatest("n_grams", F.lit(1)).cast("double"))).cast("int")


def with_language(docs: DataFrame, fit: float = FIT, dimensions: int = DIMENSIONS) -> DataFrame:
    """The documents, all columns, whose language can be told: not ``und``, and not far from how its texts of that size fit."""
    spark = docs.sparkSession
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(True))
    model = Model(*learn(docs.where(~out), dimensions))
    found = written(predicted(docs, model), "languages")
    limits = spark.createDataFrame([(*key, least) for key, least in least_fits(found, fit).items()], "l_ string, s_ int, least_ double")
    near = found.join(F.broadcast(limits), (F.col("lang_pred") == F.col("l_")) & (size_bin() == F.col("s_")))
    return near.where(F.col("fit") >= F.col("least_")).select("row_.*")
