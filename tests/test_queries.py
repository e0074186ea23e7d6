"""Every registered query against its DuckDB SQL, on the smallest tables; and the figures that plain Python gives for the larger ones."""

import duckdb
import pytest

from quaymark.operators import detect
from quaymark.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    return frame[columns].astype(str).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, duck, name):
    got, want = rows(queries.QUERIES[name](spark, SF).toPandas()), rows(duck.sql(queries.SQL[name]).df())
    assert list(got.columns) == list(want.columns) and got.equals(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_known_counts(spark):
    texts = queries.contents(spark, "/root/testdata/sf0.01")
    hits = detect.entropy_hits(texts, 3.0).select("entropy").toPandas()["entropy"]
    assert detect.tokens(texts).count() == 358
    assert [int((hits >= t).sum()) for t in (3.0, 3.5, 3.8, 4.0, 4.5)] == [113, 13, 11, 1, 0]


def test_all_rules_fire(spark):
    fired = {r.rule_name for r in queries.rule_all_inline(spark, SF).select("rule_name").distinct().collect()}
    assert fired == {r.name for r in detect.RULES}


def test_whole_tables_meet_all_rules(spark, tmp_path):
    """Documents with every rule's sample line: the queries over findings see what plain ``secrets`` sees."""
    rows = [(i, f"words before\n{line}\nand after", "en", f"s{i % 2}", len(line)) for i, line in queries.INLINE]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = detect.secrets(queries.contents(spark, str(tmp_path))).select("rule_name", "severity", "container_id").collect()
    assert {r.rule_name for r in want} == {r.name for r in detect.RULES}
    got = queries.risk_by_source(spark, str(tmp_path)).collect()
    assert {r.container_id: r.critical for r in got} == {c: sum(r.severity == "Critical" and r.container_id == c for r in want) for c in {r.container_id for r in want}}
    assert {r.rule_name for r in queries.findings(spark, str(tmp_path)).select("rule_name").distinct().collect()} - {"HIGH_ENTROPY_STRING"} == {r.name for r in detect.RULES}
    assert queries.exit_flag(spark, str(tmp_path)).first().exit_code == 2
    assert {"PRIVATE_KEY", "AWS_ACCESS_KEY"} <= {r.rule_name for r in queries.sorted_findings(spark, str(tmp_path)).collect()}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
