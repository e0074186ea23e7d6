"""Container detection and misconfiguration rules over containers and file inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark import schema
from quaymark.functions import scalars, tables

S3, GCS, AZURE, CLOUDFRONT, DIRECTORY, WEB, UNKNOWN = "AWS S3", "Google Cloud Storage", "Azure Blob Storage", "CloudFront (CDN)", "Open Directory Listing", "Generic Web File Listing", "Unknown"
S3_HOST = r"^(?:([^.]+)\.)?s3(?:[.-]([^.]+))?\.amazonaws\.com$"
GCS_HOST = r"^(?:([^.]+)\.)?storage\.googleapis\.com$"
AZURE_HOST = r"^([^.]+)\.blob\.core\.windows\.net$"


def _some(value: Column) -> Column:
    return F.when(value != "", value)


def detected(responses: DataFrame) -> DataFrame:
    """containers from raw_url, status, headers (map), body.

    In order: a provider's response headers; the host name; the listing's XML root, which overrides both, except that a
    listing without the S3 namespace leaves a host or header that says otherwise as it is; signs of an HTML index. Names
    and regions come from the host, the XML or the region header.
    """
    lower = F.transform_keys("headers", lambda k, _: F.lower(k))
    rows = responses.withColumn("headers", F.coalesce(lower, F.create_map().cast("map<string,string>"))).withColumn("body", F.coalesce("body", F.lit("")))
    host = F.lower(F.regexp_extract("raw_url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    by_header = F.lit(None).cast("string")
    for provider, names in reversed(tables.PROVIDER_HEADERS.items()):
        hit = F.lit(False)
        for name in names:
            hit = hit | F.map_contains_key("headers", F.lit(name))
        by_header = F.when(hit, provider).otherwise(by_header)
    by_host = F.when(F.col("host_").rlike(S3_HOST), S3).when(F.col("host_").rlike(r"cloudfront\.net$"), CLOUDFRONT).when(F.col("host_").rlike(GCS_HOST), GCS).when(F.col("host_").rlike(AZURE_HOST), AZURE)
    head = r"^\s*(?:<\?xml[^>]*\?>)?\s*(?:<!--.*?-->\s*)*"
    tag = F.regexp_extract("body", head + r"<(?:[A-Za-z0-9_]+:)?([A-Za-z]+)[\s>/]", 1)
    s3_space = F.regexp_extract("body", head + r"(<[^>]*>)", 1).rlike(tables.S3_NAMESPACE)
    rows = rows.withColumn("host_", host).withColumn("tag_", tag).withColumn("s3_", s3_space).withColumn("early_", F.coalesce(by_header, by_host))
    listing = F.col("tag_").isin("ListBucketResult", "ListAllMyBucketsResult")
    by_xml = F.when(F.col("s3_"), S3).when(listing & F.coalesce(F.col("early_") == GCS, F.lit(False)), GCS).when(listing, S3).when(F.col("tag_") == "EnumerationResults", AZURE)
    by_html = F.when(F.col("body").rlike(r"(?i)<title>Index of"), DIRECTORY).when(F.col("body").rlike(r"(?i)<a\s+href="), WEB)
    kind = F.coalesce(by_xml, F.col("early_"), by_html, F.lit(UNKNOWN))
    element = lambda name: _some(F.trim(F.regexp_extract("body", rf"<(?:[A-Za-z0-9_]+:)?{name}>([^<]*)<", 1)))
    endpoint = _some(F.regexp_extract(F.regexp_extract("body", r'ServiceEndpoint="([^"]*)"', 1), r"([^/]+)/*$", 1))
    host_name = F.coalesce(*[_some(F.regexp_extract("host_", p, 1)) for p in (S3_HOST, GCS_HOST, AZURE_HOST)])
    in_s3 = F.coalesce(by_xml.isin(S3, GCS), F.lit(False))
    in_azure = F.coalesce(by_xml == AZURE, F.lit(False))
    name = F.when(in_azure, F.coalesce(element("ContainerName"), host_name, endpoint)).when(in_s3, F.coalesce(host_name, element("Name"))).otherwise(host_name)
    region = F.coalesce(F.try_element_at("headers", F.lit("x-amz-bucket-region")), F.when(in_s3, element("BucketRegion")), _some(F.regexp_extract("host_", S3_HOST, 2)))
    public = F.col("status") == 200
    note = tables.text("public_s3")
    return rows.select(
        "raw_url", kind.alias("container_type"), F.coalesce(name, F.lit("")).alias("container_name"), F.coalesce(region, F.lit("")).alias("region"), public.alias("is_public"), F.coalesce(F.try_element_at("headers", F.lit("server")), F.lit("")).alias("server_header"),
        F.map_filter("headers", lambda k, _: k.isin(*tables.KEPT_HEADERS)).alias("extra_headers"), F.when(public & (kind == S3), F.array(note)).otherwise(F.array().cast("array<string>")).alias("notes"),
    )


def _of_container(df: DataFrame, **columns: Column) -> DataFrame:
    return schema.finding(
        df, file_url=F.col("raw_url"), file_name=F.when(F.col("container_name") == "", "container").otherwise(F.col("container_name")), file_type=F.lit(tables.OTHER), category=F.lit(tables.PUBLIC),
        match=F.concat(F.lit("["), F.col("container_type"), F.lit("]")), confidence=F.lit(0.99), scanner=F.lit("MisconfigAnalyzer"), **columns,
    )


def public_containers(containers: DataFrame) -> DataFrame:
    """A Critical finding per public container."""
    text = tables.text("public", F.col("container_type"))
    refs = F.array(*[F.lit(r) for r in ("CIS 2.1", "NIST SC-7", "SOC2 CC6.1", "PCI-DSS Req 1.3")])
    return _of_container(containers.where("is_public"), rule_name=F.lit("PUBLIC_BUCKET_ACCESS"), description=text, severity=F.lit("Critical"), recommendation=F.lit("Block public access, and review the policy and access lists of the container."), compliance_refs=refs, seq=schema.sequence(F.lit(-1), F.lit(0), F.lit(0), F.lit(0)))


def rule_of(pattern: str) -> str:
    return "SENSITIVE_FILE_EXPOSED:" + pattern.strip("^$")


def sensitive_files(files: DataFrame, *keys: str) -> DataFrame:
    """The first file, by ordinal, that each sensitive pattern matches, per inventory (keys): pattern_number, rule_name, label, severity, key, ordinal.

    A key is tried against all patterns in one pass, as literals that are compiled once; the rest is one aggregation.
    """
    name = F.lower("key")
    hits = F.filter(F.array(*[F.when(name.rlike(p), F.lit(i)) for i, (p, _, _) in enumerate(tables.SENSITIVE_NAMES)]), lambda x: x.isNotNull())
    # One match must be there at all before twelve are looked for.
    some = files.where(name.rlike("|".join(f"(?:{p})" for p, _, _ in tables.SENSITIVE_NAMES)))
    first = some.select(*keys, "key", "ordinal", F.explode(hits).alias("pattern_number")).groupBy(*keys, "pattern_number").agg(F.min(F.struct("ordinal", "key")).alias("f"))
    rows = [(i, rule_of(p), label, severity) for i, (p, label, severity) in enumerate(tables.SENSITIVE_NAMES)]
    dim = files.sparkSession.createDataFrame(rows, "pattern_number int, rule_name string, label string, severity string")
    return first.join(F.broadcast(dim), "pattern_number").select(*keys, "pattern_number", "rule_name", "label", "severity", F.col("f.key").alias("key"), F.col("f.ordinal").alias("ordinal"))


def sensitive_findings(containers: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of sensitive files, per container; files and containers meet by container_id = raw_url."""
    found = sensitive_files(files, "container_id").join(containers, F.col("container_id") == F.col("raw_url"))
    text = tables.text("sensitive", F.col("label"), F.col("key"))
    advice = F.concat(F.lit("Remove "), F.col("key"), F.lit(" from cloud storage and rotate any credentials in it."))
    refs = F.array(*[F.lit(r) for r in ("NIST IA-5", "CIS 2.1.5", "SOC2 CC6.7")])
    return _of_container(found, rule_name=F.col("rule_name"), description=text, severity=F.col("severity"), recommendation=advice, compliance_refs=refs, seq=schema.sequence(F.lit(-1), F.col("ordinal"), F.col("pattern_number"), F.lit(1)))
