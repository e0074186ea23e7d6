"""Scores and summaries over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.functions import scalars, tables
from quaymark.sources.kept import checkpointed


def risk(findings: DataFrame, *keys: str, count: tuple[str, ...] = ()) -> DataFrame:
    """keys, findings, risk_score, and a number for each severity in ``count``: one aggregation.

    Weights are summed as decimals, so their order does not matter. Without keys there is one row always, without findings as of a public container.
    """
    points = (tables.weight(F.col("severity")) * tables.multiplier(F.col("category"))).cast("decimal(10,2)")
    floor = (F.col("severity") == "Critical") & F.col("rule_name").isin(*tables.FLOOR_RULES)
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in count]
    sums = findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("findings"), F.sum(points).cast("double").alias("raw_"), F.coalesce(F.bool_or(floor), F.lit(False)).alias("floor_"), *counts)
    return sums.select(*keys, "findings", score(F.col("raw_"), F.col("floor_"), F.col("findings")).alias("risk_score"), *[s.lower() for s in count])


def score(raw: Column, floor: Column, n: Column, public: Column | None = None) -> Column:
    value = 10 * (1 - F.exp(-raw / 8))
    value = F.round(F.least(F.when(floor, F.greatest(value, F.lit(8.5))).otherwise(value), F.lit(10.0)), 2)
    return F.when(n > 0, value).when(F.lit(True) if public is None else F.coalesce(public, F.lit(True)), 2.0).otherwise(0.5)


def container_risk(containers: DataFrame, findings: DataFrame) -> DataFrame:
    """container_id, findings, risk_score for all containers, those without findings too."""
    points = (tables.weight(F.col("severity")) * tables.multiplier(F.col("category"))).cast("decimal(10,2)")
    floor = (F.col("severity") == "Critical") & F.col("rule_name").isin(*tables.FLOOR_RULES)
    sums = findings.groupBy("container_id").agg(F.count(F.lit(1)).alias("n_"), F.sum(points).cast("double").alias("raw_"), F.bool_or(floor).alias("floor_"))
    joined = containers.select(F.col("raw_url").alias("container_id"), "is_public").join(sums, "container_id", "left")
    n = F.coalesce("n_", F.lit(0))
    return joined.select("container_id", n.alias("findings"), score(F.col("raw_"), F.col("floor_"), n, F.col("is_public")).alias("risk_score"))


def severity_counts(findings: DataFrame, *keys: str) -> DataFrame:
    """One column per severity, zeros included."""
    return findings.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in tables.SEVERITIES])


def severity_table(findings: DataFrame) -> DataFrame:
    """severity, n for all five severities, most severe first by rank."""
    dim = findings.sparkSession.createDataFrame([(s, 4 - v[0]) for s, v in tables.SEVERITIES.items()], "severity string, position int")
    return dim.join(findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n")), "severity", "left").select("severity", "position", F.coalesce("n", F.lit(0)).alias("n"))


def top_categories(findings: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent categories; of equal ones, that of the earlier finding."""
    return findings.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_")).orderBy(F.desc("n"), "first_").limit(k).select("category", "n")


def compliance_map(findings: DataFrame, k: int = 3) -> DataFrame:
    """ref, rules: the first k rules, sorted, that trigger a control."""
    rows = findings.select(F.explode("compliance_refs").alias("ref"), "rule_name")
    return rows.groupBy("ref").agg(F.array_join(F.slice(F.array_sort(F.collect_set("rule_name")), 1, k), ", ").alias("rules"))


def critical_rules(findings: DataFrame, k: int = 4) -> DataFrame:
    return findings.where("severity = 'Critical'").agg(F.slice(F.array_sort(F.collect_set("rule_name")), 1, k).alias("rules"))


def exit_code(findings: DataFrame) -> DataFrame:
    """2 if any finding is Critical or High, else 0."""
    return findings.agg(F.when(F.coalesce(F.bool_or(F.col("severity").isin("Critical", "High")), F.lit(False)), 2).otherwise(0).alias("exit_code"))


def ordered(findings: DataFrame) -> DataFrame:
    """findings, most severe first, then in their own order."""
    return findings.orderBy(F.desc(tables.rank(F.col("severity"))), "seq", "rule_name")


def positioned(findings: DataFrame) -> DataFrame:
    """findings with ``position``, their place from 1 in the order of ``ordered``, without a task that sees them all.

    Findings are stored once, dealt out by range and sorted there; what the ranges before hold is added to the place within a range.
    """
    order = [F.desc(tables.rank(F.col("severity"))), F.asc("seq"), F.asc("rule_name")]
    held = checkpointed(checkpointed(findings).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id()))
    task = F.shiftright("at_", 33)
    first, n = [], 0
    for row in sorted(held.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()):  # a row per range
        first.append((row["task"], n))
        n += row["n"]
    base = F.broadcast(held.sparkSession.createDataFrame(first, "task_ long, first_ long"))
    place = F.col("first_") + F.col("at_").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return held.join(base, task == F.col("task_")).withColumn("position", place).drop("at_", "task_", "first_")


def run_counters(routed: DataFrame, *keys: str) -> DataFrame:
    """total, scanned, skipped and archive files, from routed files; with a column ``error``, files that could not be looked at, too."""
    failed = F.col("error").isNotNull() if "error" in routed.columns else F.lit(False)
    count = lambda *routes: F.count_if(F.col("route").isin(*routes) & ~failed)
    more = [F.count_if(failed).alias("errors")] if "error" in routed.columns else []
    return routed.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_files"), count("text").alias("scanned_files"), count("skip_type", "skip_size").alias("skipped_files"), count("archive").alias("archive_files"), *more)


def anomaly(contents: DataFrame, findings: DataFrame | None = None, ai: DataFrame | None = None) -> DataFrame:
    """file_url, anomaly_score (0 to 10), explanation for every content.

    Factors: share of lines with a token of high entropy, Critical and High findings, density of sensitive words, small
    sensitive files. ``ai`` (file_url, ai_score, ai_explanation) is blended in where the score exceeds 3. Findings are
    counted per file before the join, so a file meets one row.
    """
    text = F.col("content")
    lines = F.split(text, "\n", -1)
    loud = lambda line: F.exists(F.split(line, scalars.COARSE_DELIMITERS, -1), lambda t: (F.length(t) > 15) & scalars.may_reach(t, 4.5) & (F.round(scalars.entropy(t), 6) > 4.5))
    ratio = F.size(F.filter(lines, lambda x: x.rlike(r"(?U)[^\s=:\"',]{16}") & loud(x))) / F.greatest(F.size(lines), F.lit(1))
    low = F.lower(text)
    hits = sum(((F.length(low) - F.length(F.replace(low, F.lit(k), F.lit("")))) / len(k)).cast("long") for k in tables.KEYWORDS)
    words = F.greatest(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(1))
    rows = contents.select("file_url", ratio.alias("ratio_"), hits.alias("hits_"), (hits / words).alias("density_"), F.length(text).alias("length_"))
    if findings is None:
        rows = rows.withColumns({"critical_": F.lit(0), "high_": F.lit(0)})
    else:
        counts = findings.groupBy("file_url").agg(F.count_if(F.col("severity") == "Critical").alias("critical_"), F.count_if(F.col("severity") == "High").alias("high_"))
        rows = rows.join(counts, "file_url", "left").na.fill(0, ["critical_", "high_"])
    small = F.lower(scalars.url_filename(F.col("file_url"))).rlike(r"(\.env|\.pem|\.key)$") & (F.col("length_") < 2000)
    points = F.when(F.col("ratio_") > 0.3, 3.0).when(F.col("ratio_") > 0.1, 1.5).otherwise(0.0) + F.col("critical_") * 1.5 + F.col("high_") * 0.8
    points = points + F.when(F.col("density_") > 0.05, 2.0).when(F.col("density_") > 0.02, 0.8).otherwise(0.0) + F.when(small, 1.0).otherwise(0.0)
    percent = F.concat(F.round(F.col("ratio_") * 100, 0).cast("int").cast("string"), F.lit("% of lines"))
    reasons = F.concat_ws(
        " | ", F.when(F.col("ratio_") > 0.3, F.concat(F.lit("High entropy string density: "), percent)).when(F.col("ratio_") > 0.1, F.concat(F.lit("Elevated entropy strings: "), percent)),
        F.when(F.col("critical_") > 0, F.concat(F.col("critical_").cast("string"), F.lit(" critical-severity pattern matches"))), F.when(F.col("density_") > 0.05, F.concat(F.lit("High sensitive keyword density ("), F.col("hits_").cast("string"), F.lit(" hits)"))),
    )
    out = rows.select("file_url", F.least(points, F.lit(10.0)).alias("own_"), F.when(reasons == "", tables.TEXTS["no_anomaly"]).otherwise(reasons).alias("why_"))
    if ai is None:
        return out.select("file_url", F.round("own_", 2).alias("anomaly_score"), F.col("why_").alias("explanation"))
    joined = out.join(ai, "file_url", "left")
    used = (F.col("own_") > 3) & F.col("ai_score").isNotNull()
    blend = F.when(used, 0.6 * F.col("own_") + 0.4 * F.col("ai_score")).otherwise(F.col("own_"))
    told = F.when(used & (F.coalesce("ai_explanation", F.lit("")) != ""), F.concat(F.col("why_"), F.lit(" | AI: "), F.col("ai_explanation"))).otherwise(F.col("why_"))
    return joined.select("file_url", F.round(blend, 2).alias("anomaly_score"), told.alias("explanation"))


def heuristic_summary(counts: dict[str, int], categories: list[tuple[str, int]], rules: list[str], scanned: int, risk_score: float, container: dict[str, str]) -> str:
    """An executive summary from small aggregates, as Markdown."""
    critical, high, medium = (counts.get(s, 0) for s in ("Critical", "High", "Medium"))
    rating = "CRITICAL" if critical else "HIGH" if high > 2 else "MODERATE" if high or medium > 3 else "LOW"
    lines = ["## Executive Summary", "", f"The assessment of **{container.get('container_name') or 'Unknown'}** ({container.get('container_type') or 'Unknown'}) found **{sum(counts.values())} findings** in {scanned} scanned files. Exposure is rated **{rating}**, with a risk score of **{risk_score:.1f}/10**.", ""]
    if critical:
        lines += [f"**Critical ({critical}):** to be remedied at once; rules: {', '.join(rules)}.", ""]
    if high:
        lines += [f"**High ({high}):** to be remedied within 24-72 hours.", ""]
    if categories:
        lines += ["**Categories:** " + ", ".join(f"{c} ({n})" for c, n in categories) + ".", ""]
    lines += ["**Priorities:**", "1. Rotate exposed credentials, keys and tokens.", "2. Turn on the provider's controls against public access.", "3. Scan for secrets before every deployment."]
    return "\n".join(lines)


def windowed_context(lines: DataFrame) -> DataFrame:
    """lines (file_url, line_number, line) with ``context``: each line between its neighbours, by a window over the file."""
    w = Window.partitionBy("file_url").orderBy("line_number").rowsBetween(-1, 1)
    return lines.withColumn("context", F.substring(F.array_join(F.collect_list("line").over(w), "\n"), 1, 200))
