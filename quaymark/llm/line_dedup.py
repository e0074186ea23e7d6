"""Removal of boilerplate lines by their spread over distinct sites.

Each document gives its distinct non-blank lines as 128-bit BLAKE2b digests, which stand for the lines' bytes: no two
lines of any corpus share one, however they are built. A HyperLogLog sketch of the sites is kept per line and
merged by aggregation, so a line that every site has costs no more than any other. Estimates far above the threshold
decide for removal, far below for keeping; lines within ``SPREAD`` standard errors of it get an exact distinct count.
A boilerplate line stays in one place, the first in the least document (by doc_id, then text hash), so no content is lost;
everywhere else it is removed, and a document's other lines are joined again by newlines.

Defined results: lines are split at ``\\n`` alone and compared byte for byte; blank lines (no word) always stay; a null text
has no lines and stays null, an empty one stays empty; a null site counts as no site; null doc_ids come last; rows with equal
doc_id and text are treated alike; an empty table gives no rows. All columns of the input are kept; none of them clashes
with what is added. A document of which all lines go stays, with an empty text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm import textkernel as K
from quaymark.llm.shared import lean, packed, packed_schema, pieces_of, with_fields, written

#: HyperLogLog sketches have 2**LG_K registers; standard errors that the exact count reaches to.
LG_K, SPREAD = 12, 5.0
#: So many boilerplate lines (32 bytes each) are handed to all tasks; more are joined.
MOST_SENT = 500_000


def text_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each whole text; an empty one has a hash too."""
    return K.segment_hashes(data, offsets[:-1], offsets[1:]).view(np.int64)


def hashed_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds by text, digests, blank) of all lines."""
    starts, ends, bounds = K.lines(data, offsets)
    solid = np.concatenate([[0], np.cumsum(~K.IS_SPACE[data])])
    return starts, ends, bounds, K.digests(data, starts, ends), solid[ends] == solid[starts]


def _binary(digests: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), len(digests), [None, pa.py_buffer(np.ascontiguousarray(digests))]).cast(pa.binary())


def _digests(column: pa.Array) -> np.ndarray:
    """A column of digests as an array."""
    return np.frombuffer(b"".join(column.to_pylist()), "S16")


def occurrences(docs: DataFrame, site: str) -> DataFrame:
    """site, line, doc_id, text_hash: each line once per site and batch, with the least document there that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch):
                data, offsets = K.buffer_of(part.column("text"))
                _, _, bounds, line, blank = hashed_lines(data, offsets)
                doc = K.per_text(bounds)[~blank]
                line = line[~blank]
                key = pc.fill_null(part.column("doc_id"), np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)[doc]
                code = part.column("site").dictionary_encode()
                at = pc.fill_null(code.indices.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)[doc]
                own = text_hashes(data, offsets)[doc]
                order = np.lexsort((own, key, at, line))
                line, at, key, own = line[order], at[order], key[order], own[order]
                first = np.ones(len(line), dtype=bool)
                first[1:] = (line[1:] != line[:-1]) | (at[1:] != at[:-1])
                at = at[first]
                sites = code.dictionary.take(pa.array(at, mask=at < 0)) if len(code.dictionary) else pa.nulls(len(at), pa.string())
                yield pa.RecordBatch.from_arrays([sites, _binary(line[first]), pa.array(key[first]), pa.array(own[first])], names=["site", "line", "doc_id", "text_hash"])

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(site).cast("string").alias("site"))
    return held.mapInArrow(lean(run), "site string, line binary, doc_id long, text_hash long")


def boilerplate(docs: DataFrame, site: str, min_sites: int) -> DataFrame:
    """line, doc_id, text_hash of the lines on ``min_sites`` distinct sites at least, and the document that keeps each."""
    seen = written(occurrences(docs, site), "lines")
    spread = seen.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min(F.struct("doc_id", "text_hash")).alias("keeper"))
    error = SPREAD * 1.04 / math.sqrt(1 << LG_K)
    low, high = min_sites * (1 - error) - 1, min_sites * (1 + error) + 1
    judged = written(spread.select("line", "keeper", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= low), "spread")
    near = judged.where(F.col("sites") <= high)
    exact = seen.join(near.select("line"), "line", "left_semi").groupBy("line").agg(F.count_distinct("site").alias("n")).where(F.col("n") >= min_sites)
    out = judged.where(F.col("sites") > high).select("line", "keeper").unionByName(near.join(exact.select("line"), "line", "left_semi").select("line", "keeper"))
    return written(out.select("line", F.col("keeper.doc_id").alias("doc_id"), F.col("keeper.text_hash").alias("text_hash")), "boilerplate")


class Lines:
    """Boilerplate lines and the document that keeps each: of all documents, or (with ``of``) of each document of a batch."""

    def __init__(self, line: np.ndarray, doc_id: np.ndarray, text_hash: np.ndarray, of: np.ndarray | None = None):
        self.alike = of is None
        key = line if of is None else self._keyed(of, line)
        order = np.argsort(key, kind="stable")
        self.key, self.doc_id, self.text_hash = key[order], doc_id[order], text_hash[order]

    @staticmethod
    def _keyed(of: np.ndarray, line: np.ndarray) -> np.ndarray:
        number = of.astype(">u8").view(np.uint8).reshape(-1, 8)
        return np.ascontiguousarray(np.concatenate([number, np.ascontiguousarray(line).view(np.uint8).reshape(-1, 16)], axis=1)).view("S24").ravel()

    def find(self, line: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, whether it is there) of lines of the documents ``of``."""
        if not len(self.key):
            return np.zeros(len(line), np.int64), np.zeros(len(line), bool)
        key = line if self.alike else self._keyed(of, line)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return at, self.key[at] == key


def _strip(part: pa.RecordBatch, lines: Lines, first_row: int = 0) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(texts, lines, removed lines) of a part of a batch, whose rows are counted from ``first_row``."""
    column = part.column("text")
    data, offsets = K.buffer_of(column)
    starts, ends, bounds, digested, blank = hashed_lines(data, offsets)
    doc = K.per_text(bounds)
    n = np.diff(bounds)
    known = pc.is_valid(column).to_numpy(zero_copy_only=False)
    at, gone = lines.find(digested, doc + first_row)
    gone &= ~blank
    if gone.any():
        key = pc.fill_null(part.column("doc_id"), np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        own = text_hashes(data, offsets)
        keeps = np.flatnonzero(gone)
        keeps = keeps[(lines.doc_id[at[keeps]] == key[doc[keeps]]) & (lines.text_hash[at[keeps]] == own[doc[keeps]])]
        if len(keeps):  # the first place in the keeper
            _, first = np.unique(np.stack([doc[keeps], at[keeps]]), axis=1, return_index=True)
            gone[keeps[first]] = False
    removed = np.bincount(doc[gone], minlength=len(n))
    if removed.any():
        texts = column.to_pylist()
        raw = data.tobytes()
        for d in np.flatnonzero(removed).tolist():
            stay = np.flatnonzero(~gone[bounds[d] : bounds[d + 1]]) + bounds[d]
            texts[d] = b"\n".join(raw[starts[i] : ends[i]] for i in stay.tolist()).decode("utf-8")
        column = pa.array(texts, pa.string())
    return column.cast(pa.string()), np.where(known, n, 0), removed


def stripped(docs: DataFrame, site: str = "source", min_sites: int = 10, most_sent: int = MOST_SENT) -> DataFrame:
    """row_ (all columns of the input), text (what stays), n_lines, n_removed for every document. Up to ``most_sent`` boilerplate lines go to all tasks; more are joined."""
    found = boilerplate(docs, site, min_sites)
    rows = packed(docs)
    fields = {"doc_id": pa.int64(), "text": pa.string()}
    kind = packed_schema(rows, "text string, n_lines long, n_removed long")

    def result(part: pa.RecordBatch, lines: Lines, first_row: int = 0) -> pa.RecordBatch:
        texts, n, removed = _strip(part, lines, first_row)
        return pa.RecordBatch.from_arrays([part.column("row_"), texts, pa.array(n), pa.array(removed)], names=["row_", "text", "n_lines", "n_removed"])

    if found.count() <= most_sent:
        sent = found.toPandas()
        lines = Lines(np.array([bytes(x) for x in sent["line"]], dtype="S16"), sent["doc_id"].to_numpy(), sent["text_hash"].to_numpy())

        def by_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces_of(with_fields(batch, **fields)):
                    yield result(part, lines)

        return rows.mapInArrow(lean(by_all), kind)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(with_fields(batch, **fields)):
                data, offsets = K.buffer_of(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("row_"), pa.array(text_hashes(data, offsets))], names=["row_", "own_"])

    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch):
                data, offsets = K.buffer_of(part.column("text"))
                _, _, bounds, line, blank = hashed_lines(data, offsets)
                doc = K.per_text(bounds)[~blank]
                yield pa.RecordBatch.from_arrays([pa.array(text_hashes(data, offsets)[doc]), _binary(line[~blank])], names=["own_", "line"])

    # A text's boilerplate lines, found by joins, meet its documents again by the text's hash: one row per distinct text on that
    # side, so a text that many documents have is a skewed key of the other side alone, which the join can split.
    has = rows.select(F.col("row_.text").cast("string").alias("text")).mapInArrow(lean(lines_of), "own_ long, line binary").distinct().join(found, "line")
    mine = has.groupBy("own_").agg(F.collect_list(F.struct("line", "doc_id", "text_hash")).alias("mine_"))
    whole = rows.mapInArrow(lean(keyed), packed_schema(rows, "own_ long")).join(mine, "own_", "left")

    def by_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("mine_")
            flat, size = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            lines = Lines(_digests(flat.field("line")), flat.field("doc_id").to_numpy(), flat.field("text_hash").to_numpy(), np.repeat(np.arange(len(lists)), size))
            first_row = 0
            for part in pieces_of(with_fields(batch, **fields)):
                yield result(part, lines, first_row)
                first_row += part.num_rows

    return whole.mapInArrow(lean(by_own), kind)


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = 10) -> DataFrame:
    """The documents, all columns, with what stays of their texts (n_chars, where there is such a column, counts it anew)."""
    out = stripped(docs, site, min_sites)
    new = {"text": F.col("text"), "n_chars": F.length("text")}
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    changed = F.col("n_removed") > 0
    return out.select(*[(F.when(changed, new[c].cast(kinds[c])).otherwise(F.col(f"row_.`{c}`")) if c in new else F.col(f"row_.`{c}`")).alias(c) for c in docs.columns])
