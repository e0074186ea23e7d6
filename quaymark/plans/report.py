"""Reports as JSON, Markdown and HTML. What is rendered on the driver are small aggregates and, section by section, lines that Spark has made."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html import escape
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.functions import tables
from quaymark.operators import score

# Colours of severities.
COLOURS = {"Critical": "#c0392b", "High": "#e67e22", "Medium": "#d4ac0d", "Low": "#27ae60", "Informational": "#2980b9"}
HTML_FILES, ERRORS = 250, 20


def _flag(test: Column, text: str) -> Column:
    return F.when(test, text).otherwise("")


def markdown_lines(findings: DataFrame) -> DataFrame:
    """severity, seq, block: each finding as a Markdown block."""
    title = F.concat(F.lit("#### `"), F.col("file_name"), F.lit("` — "), F.col("rule_name"), _flag(F.col("scanner").contains("AI:"), " `[AI]`"), _flag(F.col("from_archive"), " `[ARCHIVE]`"))
    line = F.when(F.coalesce("line_number", F.lit(0)) > 0, F.col("line_number").cast("string")).otherwise("N/A")
    refs = F.when(F.size("compliance_refs") > 0, F.array_join("compliance_refs", ", ")).otherwise("N/A")
    block = F.concat(
        title, F.lit("\n\n- **Category:** "), F.col("category"), F.lit("\n- **Description:** "), F.col("description"), F.lit("\n- **Confidence:** "), F.format_string("%.0f%%", F.col("confidence") * 100), F.lit("  |  **Line:** "), line,
        F.lit("\n- **Compliance:** "), refs, F.lit("\n- **Remediation:** "), F.col("recommendation"), F.lit("\n"),
    )
    return findings.select("severity", "seq", "rule_name", block.alias("block"))


def json_report(findings: DataFrame) -> DataFrame:
    """One JSON object per finding, as a report lists it (confidence rounded, no internal columns)."""
    shown = [c for c in findings.columns if c not in ("seq", "container_id")]
    return findings.select("seq", F.to_json(F.struct(*[F.round(c, 3).alias(c) if c == "confidence" else F.col(c) for c in shown])).alias("json"))


def html_escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def html_lines(findings: DataFrame) -> DataFrame:
    block = F.concat(F.lit('<div class="f"><h4>'), html_escaped(F.col("file_name")), F.lit(" — "), html_escaped(F.col("rule_name")), F.lit("</h4><p>"), html_escaped(F.col("description")), F.lit("</p><pre>"), html_escaped(F.col("context")), F.lit("</pre></div>"))
    return findings.select("severity", "seq", "rule_name", block.alias("block"))


def badge(severity: str) -> str:
    return f'<span style="background:{COLOURS.get(severity, "#7f8c8d")};color:{"#333" if severity == "Medium" else "#fff"}">{escape(severity)}</span>'


class Report:
    """The aggregates of a scan, and the documents made of them."""

    def __init__(self, findings: DataFrame, files: DataFrame, container: dict, counters: dict, risk: float, errors: list[str], organisation: str = "", generated: str = "", summary: str = ""):
        self.findings, self.files, self.container, self.counters, self.risk, self.errors = findings, files, container, counters, risk, errors
        self.organisation, self.generated, self.summary = organisation, generated, summary
        self.counts = {r["severity"]: r["n"] for r in score.severity_table(findings).collect()}

    def _sorted(self, lines: DataFrame) -> Iterator:
        """Lines by severity and order, a partition at a time, so the driver never holds them all."""
        return lines.orderBy(F.desc(tables.rank(F.col("severity"))), "seq", "rule_name").toLocalIterator()

    def markdown(self) -> Iterator[str]:
        c = self.container
        yield from ["# Security Report", "", f"**Organisation:** {self.organisation}  ", f"**Generated:** {self.generated}  ", "", "## Container Information", "", "| Field | Value |", "|-------|-------|"]
        for k, v in (("URL", c.get("raw_url")), ("Provider", c.get("container_type")), ("Name", c.get("container_name")), ("Region", c.get("region")), ("Public", "**YES — MISCONFIGURED**" if c.get("is_public") else "No")):
            yield f"| {k} | {v or 'N/A'} |"
        yield from ["", "## Audit Summary", "", "| Metric | Value |", "|--------|-------|"]
        for k, v in (("Files Discovered", self.counters["total_files"]), ("Files Scanned", self.counters["scanned_files"]), ("Archives Extracted", self.counters["archive_files"]), ("Risk Score", f"**{self.risk:.1f} / 10**"), ("Total Findings", f"**{sum(self.counts.values())}**")):
            yield f"| {k} | {v} |"
        yield from ["", "### Severity Breakdown", "", "| Severity | Count |", "|----------|-------|"]
        for s in tables.SEVERITIES:
            yield f"| {s} | {self.counts.get(s, 0)} |"
        if self.summary:
            yield from ["", "## Executive Summary", "", self.summary]
        yield from ["", "## Technical Findings", ""]
        last = None
        for row in self._sorted(markdown_lines(self.findings)):
            if row["severity"] != last:
                last = row["severity"]
                yield from [f"### {last} ({self.counts[last]})", ""]
            yield row["block"]
        mapping = score.compliance_map(self.findings).orderBy("ref").collect()
        if mapping:
            yield from ["## Compliance Mapping", "", "| Control | Triggered By |", "|---------|------------|", *(f"| {r['ref']} | {r['rules']} |" for r in mapping)]
        if self.errors:
            yield from ["", "## Scan Errors", "", *(f"- `{e}`" for e in self.errors[:ERRORS])]

    def html(self) -> Iterator[str]:
        band = "red" if self.risk >= 7 else "amber" if self.risk >= 4 else "green"
        yield f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Security Report</title></head><body><h1>Security Report</h1><p>{escape(self.organisation)} {escape(self.generated)}</p><p class='{band}'>Risk {self.risk:.1f} / 10</p>"
        yield "<p>" + " ".join(f"{badge(s)} {self.counts.get(s, 0)}" for s in tables.SEVERITIES) + "</p>"
        for row in self._sorted(html_lines(self.findings)):
            yield badge(row["severity"]) + row["block"]
        for r in score.compliance_map(self.findings, 4).orderBy("ref").collect():
            yield f"<p><b>{escape(r['ref'])}</b>: {escape(r['rules'])}</p>"
        yield "<table>"
        for r in self.files.orderBy("ordinal").limit(HTML_FILES).collect():
            yield f"<tr><td>{escape(r['key'][:80])}</td><td>{r['size_bytes'] // 1024} KB</td></tr>"
        yield "</table></body></html>"

    def json(self) -> Iterator[str]:
        head = {"organisation": self.organisation, "generated_at": self.generated}
        scan = {"container": self.container, **self.counters, "risk_score": self.risk, "errors": self.errors, "ai_summary": self.summary}
        yield f'{{"meta": {json.dumps(head)}, "scan": {json.dumps(scan, default=str)[:-1]}, "findings": ['
        first = True
        for row in json_report(self.findings).orderBy("seq").toLocalIterator():
            yield ("" if first else ",") + row["json"]
            first = False
        yield "]}}"

    def write(self, base: str, kind: str = "all") -> list[str]:
        """Writes the report in one format or all; ``base`` loses its last suffix."""
        out = []
        for name, suffix in (("json", ".json"), ("html", ".html"), ("markdown", ".md")):
            if kind in ("all", name) or (kind == "md" and name == "markdown"):
                path = Path(base).with_suffix(suffix)
                with path.open("w", encoding="utf-8") as f:
                    for line in getattr(self, name)():
                        f.write(line + "\n")
                out.append(str(path))
        return out
