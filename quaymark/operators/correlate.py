"""Findings across files: duplicates, reuse, exposure surface. Each is one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaymark import schema
from quaymark.functions import scalars, tables


def duplicates(findings: DataFrame, strict: bool = False) -> DataFrame:
    """One Critical finding per match that occurs twice or more; ``strict`` asks for two different files. Groups are of the match's fingerprint, so no value is kept."""
    keyed = findings.withColumn("hash_", scalars.fingerprint(F.col("match")))
    counted = keyed.groupBy("hash_").agg(F.count(F.lit(1)).alias("n_"), F.min(F.struct("seq", "file_url", "rule_name")).alias("first_"), F.count_distinct("file_url").alias("files_"))
    # Five names of each group: a limit per group is taken before the shuffle too, so a match that is everywhere is not gathered.
    names = keyed.select("hash_", scalars.url_filename(F.col("file_url")).alias("name_")).distinct().withColumn("nth_", F.row_number().over(Window.partitionBy("hash_").orderBy("name_"))).where("nth_ <= 5")
    grouped = counted.join(names.groupBy("hash_").agg(F.array_sort(F.collect_list("name_")).alias("names_")), "hash_")
    rule = F.col("first_.rule_name")
    n = F.col("files_").cast("string")
    text = tables.text("duplicate", rule, n, F.array_join("names_", ", "), F.when(F.col("files_") > 5, "...").otherwise(""))
    return schema.finding(
        grouped.where(F.col("files_" if strict else "n_") >= 2), file_url=F.col("first_.file_url"), file_name=tables.text("many_files"), file_type=F.lit(tables.OTHER), category=F.lit(tables.SECRET), rule_name=F.concat(F.lit("DUPLICATE_SECRET:"), rule),
        description=text, severity=F.lit("Critical"), match=tables.text("duplicate_match", n), recommendation=F.lit("One secret in several places points to shared or copied credentials. Give each service its own and rotate those affected."),
        compliance_refs=F.array(F.lit("NIST IA-5"), F.lit("SOC2 CC6.7")), confidence=F.lit(0.99), scanner=F.lit("SecretDeduplicator"), seq=F.col("first_.seq"),
    )


def reuse(findings: DataFrame, min_files: int = 3) -> DataFrame:
    """One High finding per rule that fires in ``min_files`` files or more."""
    grouped = findings.groupBy("rule_name").agg(F.count_distinct("file_url").alias("files_"), F.min("file_url").alias("first_"), F.min("seq").alias("seq"))
    n = F.col("files_").cast("string")
    return schema.finding(
        grouped.where(F.col("files_") >= min_files), file_url=F.col("first_"), file_name=tables.text("many_files"), file_type=F.lit(tables.OTHER), category=F.lit(tables.SECRET),
        description=tables.text("reuse", F.col("rule_name"), n),
        rule_name=F.concat(F.lit("CREDENTIAL_REUSE:"), F.col("rule_name")), severity=F.lit("High"), match=tables.text("reuse_match", n), recommendation=F.lit("Use scoped credentials per service, or roles in their place, and rotate those affected."),
        compliance_refs=F.array(F.lit("NIST IA-5"), F.lit("CIS 2.1")), confidence=F.lit(0.85), scanner=F.lit("SecretDeduplicator"),
    )


def exposure_surface(findings: DataFrame, *keys: str) -> DataFrame:
    """What kinds of data are exposed, per key: sorted label lists, highest severity, frameworks in order of their first finding, score, summary."""
    rule = scalars.base_rule(F.col("rule_name"))
    some = lambda rules, value: F.array_sort(F.collect_set(F.when(rule.isin(*rules), value)))
    grouped = findings.groupBy(*keys).agg(
        some(tables.CREDENTIAL_RULES, scalars.label(F.col("description"))).alias("credential_types"), some(tables.PII_RULES, F.col("description")).alias("pii_categories"), some(tables.INFRASTRUCTURE_RULES, F.col("description")).alias("infra_details"),
        F.max_by("severity", tables.rank(F.col("severity"))).alias("highest_severity"),
    )
    part = lambda name, label: F.when(F.size(name) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.slice(name, 1, {"credential_types": 5, "infra_details": 3}.get(name, 1 << 30)), ", ")))
    summary = F.concat_ws(" | ", part("credential_types", "Credentials"), part("pii_categories", "PII"), part("infra_details", "Infrastructure"))
    scored = grouped.withColumn("total_exposure_score", 2.0 * F.size("credential_types") + 1.5 * F.size("pii_categories") + 0.5 * F.size("infra_details")).withColumn("summary", F.when(summary == "", tables.TEXTS["no_surface"]).otherwise(summary))
    gaps = findings.select(*keys, "seq", F.posexplode("compliance_refs").alias("pos_", "ref_")).groupBy(*keys, scalars.framework(F.col("ref_")).alias("framework_")).agg(F.min(F.struct("seq", "pos_")).alias("at_"))
    ordered = gaps.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at_", "framework_"))), lambda x: x["framework_"]).alias("compliance_gaps"))
    joined = scored.join(ordered, list(keys), "left") if keys else scored.crossJoin(ordered)  # one row each without keys
    return joined.withColumn("compliance_gaps", F.coalesce("compliance_gaps", F.array().cast("array<string>")))
