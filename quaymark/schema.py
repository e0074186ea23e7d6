"""The record types that operators exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTAINERS = "raw_url string, container_type string, container_name string, region string, is_public boolean, server_header string, extra_headers map<string,string>, notes array<string>"
FILES = "url string, key string, size_bytes long, last_modified string, file_type string, etag string, ordinal long, container_id string"
#: seq is an order of findings that survives shuffles: file, line, rule, match.
FINDINGS = {
    "file_url": "string",
    "file_name": "string",
    "file_type": "string",
    "category": "string",
    "rule_name": "string",
    "description": "string",
    "severity": "string",
    "match": "string",
    "context": "string",
    "line_number": "int",
    "recommendation": "string",
    "compliance_refs": "array<string>",
    "confidence": "double",
    "scanner": "string",
    "from_archive": "boolean",
    "archive_path": "string",
    "container_id": "string",
    "seq": "struct<file:long,line:int,rule:int,nth:int>",
}


def finding(df: DataFrame, **columns: Column) -> DataFrame:
    """df as findings: the columns given, the rest from df if it has them, else empty."""
    default = {"context": F.lit(""), "recommendation": F.lit(""), "archive_path": F.lit(""), "from_archive": F.lit(False), "compliance_refs": F.array().cast("array<string>")}
    pick = lambda name: columns.get(name, F.col(name) if name in df.columns else default.get(name, F.lit(None)))
    return df.select(*[pick(name).cast(kind).alias(name) for name, kind in FINDINGS.items()])


def sequence(file: Column, line: Column, rule: Column, nth: Column) -> Column:
    return F.struct(file.cast("long").alias("file"), line.cast("int").alias("line"), rule.cast("int").alias("rule"), nth.cast("int").alias("nth"))
