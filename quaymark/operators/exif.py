"""Findings from image metadata: positions, devices, persons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark import schema
from quaymark.functions import scalars, tables

TAGS = "file_url string, tags map<string,string>, gps struct<lat:struct<d:double,m:double,s:double,ref:string>,lon:struct<d:double,m:double,s:double,ref:string>>"


def position(gps: str = "gps") -> Column:
    """Latitude and longitude in degrees, five digits."""
    part = lambda k: scalars.decimal_degrees(*[F.col(f"{gps}.{k}.{x}") for x in ("d", "m", "s", "ref")])
    return F.format_string("%.5f, %.5f", part("lat"), part("lon"))


def findings(images: DataFrame) -> DataFrame:
    """images: file_url, tags (map), gps (struct, null if there is none)."""
    images = images.withColumn("file_type", F.lit("Image"))
    common = {"file_name": scalars.url_filename(F.col("file_url")), "scanner": F.lit("ImageMetaAnalyser")}
    some = lambda names, show: F.array_join(F.transform(F.filter(F.array(*[F.struct(F.lit(n).alias("k"), F.try_element_at("tags", F.lit(n)).alias("v")) for n in names]), lambda x: x["v"].isNotNull() & (x["v"] != "")), show), ", ")
    device = some(tables.DEVICE_TAGS, lambda x: F.concat(x["k"], F.lit("="), F.substring(x["v"], 1, 40)))
    person = some(tables.PERSON_TAGS, lambda x: F.concat(x["k"], F.lit("=***")))
    strip = F.lit("Strip image metadata before upload.")
    rows = images.withColumn("device_", device).withColumn("person_", person)
    ordinal = F.col("ordinal") if "ordinal" in images.columns else F.lit(0)
    seq = lambda k: schema.sequence(ordinal, F.lit(0), F.lit(k), F.lit(0))
    gps = schema.finding(rows.where("gps IS NOT NULL"), category=F.lit(tables.METADATA), rule_name=F.lit("IMAGE_GPS_COORDINATES"), description=tables.text("gps"), severity=F.lit("Medium"), match=F.coalesce(position(), tables.text("gps_match")), recommendation=strip, compliance_refs=F.array(F.lit("SOC2 CC6.7")), confidence=F.lit(0.95), seq=seq(0), **common)
    devices = schema.finding(rows.where("device_ <> ''"), category=F.lit(tables.METADATA), rule_name=F.lit("IMAGE_DEVICE_INFO"), description=tables.text("device"), severity=F.lit("Low"), match=F.col("device_"), recommendation=strip, confidence=F.lit(0.9), seq=seq(1), **common)
    persons = schema.finding(rows.where("person_ <> ''"), category=F.lit(tables.PII), rule_name=F.lit("IMAGE_AUTHOR_INFO"), description=tables.text("person"), severity=F.lit("Low"), match=F.col("person_"), recommendation=strip, compliance_refs=F.array(F.lit("SOC2 CC6.7")), confidence=F.lit(0.85), seq=seq(2), **common)
    return gps.unionByName(devices).unionByName(persons)
