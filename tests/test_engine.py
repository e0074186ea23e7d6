"""Scalars against plain Python, rules in depth, providers, a whole scan, reports, and streams."""

import collections
import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaymark.functions import scalars, tables
from quaymark.operators import ai, correlate, detect, score
from quaymark.plans import queries
from quaymark.plans.report import Report
from quaymark.plans.scan import Config, scan
from quaymark.streaming import scan as streaming


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def bits(t):
    return -sum(n / len(t) * math.log2(n / len(t)) for n in collections.Counter(t).values()) if t else 0.0


@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
@settings(deadline=None, max_examples=15)
def test_entropy(spark, values):
    values = [v.replace("\0", "0") for v in values if not any(0xD800 <= ord(c) < 0xE000 for c in v)] or [""]
    rows = spark.createDataFrame([(v,) for v in values], "x string").select("x", scalars.entropy(F.col("x")).alias("h"), scalars.redact(F.col("x")).alias("r")).collect()
    for r in rows:
        assert abs(r.h - bits(r.x)) < 1e-9 and 0 <= r.h <= math.log2(max(len(r.x), 1)) + 1e-9
        assert r.r == ("***" if len(r.x) <= 6 else r.x[:6] + "***")


@pytest.mark.parametrize(("n", "want"), [(0, "0.0 B"), (1536, "1.0 KB"), (1048576, "1.0 MB"), (5 * 1024**4, "5.0 TB"), (5000 * 1024**4, "5000.0 TB")])
def test_human_size(spark, n, want):
    assert one(spark, scalars.human_size, n, "long") == want


@pytest.mark.parametrize(("url", "want"), [("https://h/a/b.txt?x=1", "b.txt"), ("https://h/", "https://h/"), ("https://h/a/", "a"), ("k", "k"), ("https://h/a;p=1", "a"), ("d/x#y", "x")])
def test_url_filename(spark, url, want):
    assert one(spark, scalars.url_filename, url) == want


def found_in(spark, *lines, rules=detect.RULES):
    rows = spark.createDataFrame([(i, f"https://h/{i}.txt", "Other", s) for i, s in enumerate(lines)], "ordinal long, file_url string, file_type string, content string")
    return detect.secrets(rows, rules).orderBy("seq").collect()


def test_rules_place_their_matches(spark):
    got = found_in(spark, "a\nmail a@b.org then c@d.org\n\nx", None, "", "no", "card 4111111111111111\n10.1.2.3")
    assert [(r.seq.file, r.line_number, r.rule_name, r.match) for r in got] == [(0, 2, "EMAIL_ADDRESS", "***" if len("a@b.org") <= 6 else "a@b.or***"), (0, 2, "EMAIL_ADDRESS", "c@d.or***"), (4, 1, "CREDIT_CARD", "411111***"), (4, 2, "INTERNAL_IP", "10.1.2***")]


def test_escalation(spark):
    low = "api" + "_key = " + "abcdefghijklmnopqrstuvwx"  # 4.58 bits
    high = "api" + "_key = " + "".join(dict.fromkeys(queries._mixed(62, 1, queries.WIDE)))  # 5.95 bits
    assert [r.severity for r in found_in(spark, low, high) if r.rule_name == "GENERIC_API_KEY"] == ["Medium", "High"]


def test_no_secret_leaks(spark):
    lines = [s for _, s in queries.INLINE]
    for r in found_in(spark, *lines):
        assert r.match == "***" or (r.match.endswith("***") and len(r.match) == 9)


def test_entropy_context_is_redacted(spark):
    token = queries._mixed(40, 3, queries.WIDE)
    rows = spark.createDataFrame([(0, "https://h/a.py", "Python", f"before\nx = {token}\nafter")], "ordinal long, file_url string, file_type string, content string")
    r = detect.entropy_findings(rows).first()
    assert (r.line_number, r.context, r.match, r.severity) == (2, f"before\nx = {token[:6]}***\nafter", token[:6] + "***", "Low")


def test_flagged_lines_are_left_out(spark):
    mail = queries._mixed(40, 3, queries.WIDE) + "@example.org"
    rows = spark.createDataFrame([(0, "u", "Other", mail)], "ordinal long, file_url string, file_type string, content string")
    assert [r.rule_name for r in detect.scan(rows).collect()] == ["EMAIL_ADDRESS"]
    assert detect.entropy_findings(rows).count() == 1


def test_scan_equals_its_parts(spark):
    """The narrow plan against rules, anti-join, first hit and context as separate operators."""
    texts = queries.contents(spark, "/root/testdata/sf0.01").limit(400)
    noisy = texts.withColumn("content", F.when(F.col("ordinal") % 3 == 0, F.concat("content", F.lit("\nkey " + queries._mixed(30, 5, queries.WIDE) + " b " + queries._mixed(40, 6, queries.WIDE)))).when(F.col("ordinal") % 7 == 0, None).otherwise(F.col("content"))).cache()
    rules = detect.secrets(noisy)
    want = rules.unionByName(detect.entropy_findings(noisy, 3.0, rules))
    f = lambda df: sorted((str(r) for r in df.select(*sorted(df.columns)).collect()))
    got = f(detect.scan(noisy, 3.0))
    assert got == f(want) and len(got) > 100


def test_correlation_without_findings(spark):
    none = queries.findings(spark, "/root/testdata/sf0.001").limit(0)
    assert correlate.duplicates(none).count() == correlate.reuse(none).count() == 0
    assert score.risk(none).first().risk_score == 2.0
    assert score.exit_code(none).first().exit_code == 0
    surface = correlate.exposure_surface(none).first()
    assert surface.summary == "No significant exposure surface" and surface.compliance_gaps == []


def test_risk_grows_with_findings(spark):
    rows = [(n, "Medium", "Secret Exposure", "R") for n in range(1, 8) for _ in range(n)]
    got = [r.risk_score for r in score.risk(spark.createDataFrame(rows, "k int, severity string, category string, rule_name string"), "k").orderBy("k").collect()]
    assert got == sorted(got) and got[0] < got[-1] <= 10


class Echo:
    def complete(self, prompt, max_tokens=1500):
        return ai.Reply(json.dumps({"findings": [{"type": "seen", "severity": "low", "line_hint": str(len(prompt))}]}), "echo", "1")


class Broken:
    def complete(self, prompt, max_tokens=1500):
        raise OSError("down")


class Refused:
    def complete(self, prompt, max_tokens=1500):
        raise ai.AuthenticationError("no")


def test_questions():
    asked = []

    class Recorder:
        def complete(self, prompt, max_tokens=1500):
            asked.append((prompt, max_tokens))
            return ai.Reply('{"score": 12, "explanation": "odd"}', "r", "1")

    one = Recorder()
    assert ai.summarised(one, "x" * 20_000).ok and ai.analysed(one, "f", "Other", "y" * 9000).ok
    assert ai.anomaly_rated(one, "f", ["t"] * 30, ["r"] * 30) == (10.0, "odd") and ai.anomaly_rated(ai.Heuristic(), "f", [], []) == (None, "")
    assert [m for _, m in asked] == [1500, 800, 200] and asked[0][0].count("x") <= 10_010 and asked[1][0].count("y") <= 4100 and asked[2][0].count('"t"') == 10


def test_chain_by_name(monkeypatch):
    monkeypatch.setattr(ai, "MAKERS", {"echo": lambda key, options: Echo(), "bad": lambda key, options: 1 / 0})
    assert ai.chain_for(None).complete("x").provider == "heuristic" == ai.chain_for("bad", "k").complete("x").provider
    assert ai.chain_for("ECHO", "k").complete("x").provider == "echo" == ai.chain_for("echo", needs_key=False).complete("x").provider
    with pytest.raises(ai.AuthenticationError):
        ai.chain_for("echo")
    with pytest.raises(ValueError):
        ai.chain_for("other", "k")


def test_keys_and_clocks(spark):
    rows = [("openai", "sk-" + "a" * 20, True), ("openai", "sk-a", False), ("claude", "sk-ant-" + "b" * 40, True), ("gemini", None, False), ("ollama", "", True), ("ollama", None, True)]
    got = spark.createDataFrame(rows, "p string, k string, ok boolean").withColumn("got", scalars.key_format_ok(F.col("p"), F.col("k"))).collect()
    assert all(r.ok == r.got for r in got)
    assert spark.sql("SELECT timestamp'2024-01-01 00:00:00' a, timestamp'2024-01-01 00:01:01.239' b").select(scalars.elapsed(F.col("a"), F.col("b"))).first()[0] == 61.24


@pytest.mark.parametrize("n", [0, 1, 300])
def test_positions(spark, n):
    rows = [(["Low", "Critical", "High"][i % 3], i * 7 % 101, f"r{i % 4}") for i in range(n)]
    held = spark.createDataFrame(rows, "severity string, seq int, rule_name string").repartition(5)
    got = [tuple(r) for r in score.positioned(held).orderBy("position").collect()]
    order = {"Critical": 0, "High": 1, "Low": 2}
    assert [r[3] for r in got] == list(range(1, n + 1)) and [r[:3] for r in got] == sorted(rows, key=lambda r: (order[r[0]], r[1], r[2]))


def test_chain():
    assert ai.Chain([Broken(), Echo()]).complete("x").provider == "echo"
    assert ai.Chain([Broken()]).complete("x") == ai.Reply("", "heuristic", "builtin")
    with pytest.raises(ai.AuthenticationError):
        ai.Chain([Refused(), Echo()]).complete("x")


@pytest.mark.parametrize("bad", [{"url": "ftp://x"}, {"url": "https://x", "owned": False}, {"url": "https://x", "min_severity": "Odd"}, {"url": "https://x", "max_file_bytes": 0}, {"url": "https://x", "organisation": ""}, {"url": "https://x", "concurrency": 0}, {"url": "https://x", "timeout": 0}])
def test_config(bad):
    with pytest.raises(ValueError):
        Config(**bad)


def test_whole_scan(spark, tmp_path):
    from tests.test_sources import tiff, zipped

    base = "https://bkt.s3.us-east-1.amazonaws.com/"
    key = "AKI" + "A" + queries._mixed(16, 1, queries.UPPER)
    objects = {"app/.env": f"K={key}\n".encode(), "b.txt": b"mail a@example.org", "c.zip": zipped({"in.py": f"k = '{key}'".encode()}), "d.zip": b"broken", "e.tiff": tiff(), "f.mp4": b"video", "g.txt": b"x" * 500, "vendor/h.txt": b"a@example.org"}
    files = spark.createDataFrame([(base + k, k, len(v), "", "", i, base) for i, (k, v) in enumerate(objects.items())], "url string, key string, size_bytes long, last_modified string, etag string, ordinal long, container_id string").withColumn("file_type", scalars.file_type(F.col("url")))
    held = spark.createDataFrame([(base + k, v) for k, v in objects.items()], "file_url string, content binary")
    from quaymark.operators import misconfig

    containers = misconfig.detected(spark.createDataFrame([(base, 200, {}, "")], "raw_url string, status int, headers map<string,string>, body string"))
    result = scan(Config(base, max_file_bytes=400, provider=Echo()), containers, files, held)
    found = result.findings.collect()
    assert {r.rule_name for r in found} == {"PUBLIC_BUCKET_ACCESS", "SENSITIVE_FILE_EXPOSED:\\.env", "AWS_ACCESS_KEY", "EMAIL_ADDRESS", "IMAGE_GPS_COORDINATES", "IMAGE_DEVICE_INFO", "IMAGE_AUTHOR_INFO", "AI_SEEN", "DUPLICATE_SECRET:AWS_ACCESS_KEY"}
    assert [r.archive_path for r in found if r.from_archive] == ["in.py"]
    assert result.counters.first().asDict() == {"total_files": 5, "scanned_files": 2, "skipped_files": 0, "archive_files": 1, "errors": 1}
    assert [r.file_url for r in result.errors.collect()] == [base + "d.zip"]
    risk = result.risk.first().risk_score
    assert 8.5 <= risk <= 10
    report = Report(result.findings, files, containers.first().asDict(), result.counters.first().asDict(), risk, ["one"], "Org", "now", "short")
    paths = report.write(str(tmp_path / "r.v1"))
    assert [p.rpartition(".")[2] for p in paths] == ["json", "html", "md"]
    data = json.loads((tmp_path / "r.json").read_text())
    assert len(data["scan"]["findings"]) == len(found) and key not in (tmp_path / "r.json").read_text() + (tmp_path / "r.md").read_text() + (tmp_path / "r.html").read_text()
    assert "| Critical |" in (tmp_path / "r.md").read_text() and "### Critical" in (tmp_path / "r.md").read_text()


def test_heuristic_summary():
    text = score.heuristic_summary({"Critical": 1, "High": 2}, [("Secret Exposure", 3)], ["R"], 7, 8.5, {"container_name": "b", "container_type": "AWS S3"})
    assert "**CRITICAL**" in text and "**3 findings**" in text and "8.5/10" in text


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    schema = "ordinal long, file_url string, file_type string, content string, container_id string"
    for i, text in enumerate(("a@example.org", "b@example.org\nc@example.org")):
        spark.createDataFrame([(i, f"u{i}", "Other", text, "c")], schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).parquet(str(source))
    query = streaming.scan_into(stream, str(tmp_path / "out"), str(tmp_path / "state"), once=True)
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("rule_name = 'EMAIL_ADDRESS'").count() == 3
    named = streaming.rule_findings(stream).writeStream.format("memory").queryName("found").outputMode("append").trigger(availableNow=True).start()
    named.awaitTermination(120)
    assert spark.table("found").count() == 3


def test_stream_windows(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:01:00' + make_interval(0, 0, 0, 0, 0, cast(id AS int), 0) AS ts, 'a' AS event_type FROM range(120)").write.parquet(str(tmp_path / "ev"))
    events = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "ev"))
    q = streaming.counted(events, "30 minutes", "10 minutes", "event_type").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r.n for r in spark.table("counted").collect()) == 120


def test_tables_are_consistent():
    assert set(tables.FLOOR_RULES) <= set(tables.CREDENTIAL_RULES) and {r.name for r in detect.RULES} >= set(tables.CREDENTIAL_RULES + tables.PII_RULES + tables.INFRASTRUCTURE_RULES)
    assert all(r.severity in tables.SEVERITIES and r.category in tables.CATEGORIES for r in detect.RULES)
