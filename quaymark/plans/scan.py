"""A whole scan as one set of plans: files and contents in; findings, counters, risk and report out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.functions import tables
from quaymark.operators import ai, correlate, detect, exif, filters, misconfig, score
from quaymark.sources import archives, images, listings
from quaymark.sources.kept import checkpointed


@dataclass(frozen=True)
class Config:
    """Options of a scan. Checked when made."""

    url: str
    owned: bool = True
    organisation: str = "unnamed"
    concurrency: int = 8
    timeout: float = 30.0
    min_entropy: float = 4.5
    min_severity: str | None = None
    max_file_bytes: int = filters.MAX_FILE_BYTES
    extensions: tuple[str, ...] = ()
    ignored: tuple[str, ...] = tables.IGNORED
    deep_metadata: bool = True
    extract_archives: bool = True
    strict_duplicates: bool = False
    provider: ai.Provider | None = field(default=None)

    def __post_init__(self):
        if not self.url.startswith(("http://", "https://")):
            raise ValueError("url must begin with http:// or https://")
        if not self.owned:
            raise ValueError("a scan needs confirmed ownership")
        if not self.organisation:
            raise ValueError("a report needs an organisation")
        if not 1 <= self.concurrency <= 100 or self.timeout <= 0:
            raise ValueError("concurrency must be 1 to 100, and timeout positive")
        if self.max_file_bytes <= 0 or not 0 <= self.min_entropy <= 24:
            raise ValueError("limits must be positive")
        if self.min_severity is not None and self.min_severity not in tables.SEVERITIES:
            raise ValueError(f"min_severity must be one of {', '.join(tables.SEVERITIES)}")


@dataclass(frozen=True)
class Result:
    findings: DataFrame
    counters: DataFrame
    risk: DataFrame
    errors: DataFrame


def scan(config: Config, containers: DataFrame, files: DataFrame, objects: DataFrame) -> Result:
    """containers, files (url, key, size_bytes, file_type, ordinal, container_id) and objects (file_url, content as bytes).

    Files are filtered and routed before they meet their contents, so what is not looked at is not read, and they meet them once.
    Findings are stored once; counters, risk and reports read that table.
    """
    kept = filters.included(files, config.extensions, config.ignored, config.max_file_bytes, keep_images=config.deep_metadata)
    routed = filters.routed(kept, config.max_file_bytes, config.deep_metadata, config.extract_archives)
    looked = F.col("route").isin("text", "archive", "image")
    names = routed.where(looked).select(F.col("url").alias("file_url"), "file_type", "ordinal", "container_id", "route")
    met = names.join(objects.select("file_url", "content"), "file_url")
    of = lambda route: met.where(F.col("route") == route).drop("route")
    texts = listings.decoded(of("text"))
    # Members carry their archive's order and container; an archive is unpacked once.
    members = archives.texts(archives.unpacked(of("archive")))
    found = checkpointed(detect.scan(texts, config.min_entropy).unionByName(detect.secrets(members)))
    errors = checkpointed(archives.unreadable(of("archive")).select("file_url", "error"))
    all_found = misconfig.public_containers(containers).unionByName(misconfig.sensitive_findings(containers, kept)).unionByName(found)
    if config.deep_metadata:
        tags = images.read(of("image").select("file_url", "content")).join(names.select("file_url", "ordinal", "container_id"), "file_url")
        all_found = all_found.unionByName(exif.findings(tags))
    if config.provider is not None:
        worth = ai.worth_asking(texts, found)
        all_found = all_found.unionByName(ai.parsed(ai.asked(worth, config.provider)))
    all_found = all_found.unionByName(correlate.duplicates(found, config.strict_duplicates)).unionByName(correlate.reuse(found))
    if config.min_severity is not None:
        all_found = filters.at_least(all_found, config.min_severity)
    all_found = checkpointed(all_found)
    counted = routed.join(errors.select(F.col("file_url").alias("url"), "error"), "url", "left")
    return Result(all_found, score.run_counters(counted), score.container_risk(containers, all_found), errors)
