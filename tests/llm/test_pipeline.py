"""The pipeline's stages on a small corpus with nulls, junk, boilerplate and copies; and the registered queries."""

import collections
import random

import pytest

import corpus_pipeline as P
from quaymark.llm import bpe, queries

LETTERS = {"en": "the of and ing tion er", "de": "der die und ung sch ei", "fr": "le des que eau ent é"}


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    word = lambda lang: "".join(r.choice(LETTERS[lang].split()) for _ in range(r.randint(1, 3)))
    rows = []
    for i in range(120):
        lang = ("en", "de", "fr")[i % 3]
        lines = [" ".join(word(lang) for _ in range(r.randint(8, 20))) for _ in range(r.randint(2, 6))] + (["Licensed under some licence."] if i % 5 else [])
        rows.append((i, "\n".join(lines), lang, f"s{i % 12}", 0, "x"))
    rows += [(200 + i, rows[i][1], rows[i][2], "s1", 0, "x") for i in range(10)]
    rows += [(210, rows[30][1] + " more", "en", "s2", 0, "x"), (300, "123 456 !!", None, "s1", 0, None), (301, None, None, None, None, None), (302, "", "en", "s1", 0, None), (None, rows[5][1], None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3)


def test_stages(spark, docs, tmp_path):
    from quaymark.llm.shared import written

    assert [name for name, _ in P.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "packing"]
    kept, at = [docs], docs
    for name, stage in P.STAGES[:-1]:
        at = written(stage(spark, at, str(tmp_path)), "stage")
        assert at.schema == docs.schema, name
        kept.append(at)
    ids = [sorted(r.doc_id for r in k.select("doc_id").collect() if r.doc_id is not None) for k in kept]
    assert ids[1] == sorted(set(ids[0]) - {300, 301, 302}) and ids[2] == ids[1]
    assert sum("Licensed" in r.text for r in kept[2].collect()) == 1 < sum("Licensed" in r.text for r in kept[1].collect())
    assert ids[3] == list(range(120))  # copies and the near copy go, nothing else does
    assert set(ids[4]) <= set(ids[3]) and max(collections.Counter(ids[4]).values()) <= 3
    pieces = P.STAGES[-1][1](spark, at, str(tmp_path)).collect()
    tokenizer = bpe.Encoder(bpe.default_path()).tokenizer
    total = sum(len(e.ids) + 1 for e in tokenizer.encode_batch([r.text for r in at.collect()], add_special_tokens=False))
    assert sum(p.length for p in pieces) == total


def test_empty(spark, docs, tmp_path):
    at = docs.limit(0)
    for _, stage in P.STAGES:
        out = stage(spark, at, str(tmp_path))
        assert out.count() == 0


def test_registered(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_line_query_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, sf).toPandas(), c.sql(sql).df()
        columns = sorted(got.columns)
        f = lambda x: x[columns].astype(str).sort_values(columns).reset_index(drop=True)  # noqa: B023, E731
        assert sorted(want.columns) == columns and f(got).equals(f(want))
