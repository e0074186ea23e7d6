"""Detectors over text: secret rules and high-entropy tokens. Both are narrow, native plans.

contents: file_url, file_type, ordinal, container_id, content (and, for archive members, archive_path).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark import schema
from quaymark.functions import scalars, tables


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    pattern: str
    description: str
    category: str = tables.SECRET
    refs: tuple[str, ...] = ()
    least_entropy: float | None = None
    #: Text that a line must hold before its pattern is tried (any of them; lower case if the pattern ignores case).
    hints: tuple[str, ...] = ()
    fold: bool = False
    #: A word that the line must hold as well.
    near: str | None = None
    validator: str | None = None
    confidence: float = 0.9
    recommendation: str = "Rotate the credential and load it from a secret store."


#: Patterns are written for Java and RE2 alike; group 1 is the match.
RULES = (
    Rule("AWS_ACCESS_KEY", "Critical", r"((?:AKIA|ASIA|ABIA)[A-Z0-9]{16})(?:[^A-Z0-9]|$)", "AWS access key", refs=("CIS 2.1.5", "NIST IA-5"), least_entropy=3.5, hints=("AKIA", "ASIA", "ABIA"), confidence=0.95),
    Rule("AWS_SECRET_KEY", "Critical", r"(?:^|[^A-Za-z0-9/+=])([A-Za-z0-9/+]{40})(?:[^A-Za-z0-9/+=]|$)", "AWS secret key", refs=("CIS 2.1.5", "NIST IA-5"), least_entropy=4.5, hints=("aws_secret",), fold=True, near="aws_secret", confidence=0.9),
    Rule("AWS_SESSION_TOKEN", "High", r"([A-Za-z0-9/+]{100,}={0,2})", "AWS session token", least_entropy=4.0, hints=("session_token", "sessiontoken"), fold=True, near="session", confidence=0.85),
    Rule("GCP_API_KEY", "High", r"(AIza[0-9A-Za-z_-]{35})", "GCP API key", least_entropy=3.5, hints=("AIza",), confidence=0.95),
    Rule("GCP_SERVICE_ACCOUNT_KEY", "Critical", r'"private_key"\s*:\s*"([^"]{32,})"', "GCP service account key", refs=("CIS 2.1.5", "NIST IA-5"), least_entropy=4.5, hints=('"private_key"',), confidence=0.95),
    Rule("GCP_OAUTH_TOKEN", "High", r"(ya29\.[0-9A-Za-z_-]{20,})", "GCP OAuth token", least_entropy=4.0, hints=("ya29.",), confidence=0.9),
    Rule("AZURE_STORAGE_KEY", "Critical", r"AccountKey=([A-Za-z0-9+/]{40,}={0,2})", "Azure storage account key", refs=("CIS 2.1.5", "NIST IA-5"), least_entropy=4.5, hints=("AccountKey=",), confidence=0.95),
    Rule("AZURE_SAS_TOKEN", "High", r"[?&]sig=([A-Za-z0-9%/+]{20,}=?)", "Azure SAS token", least_entropy=3.5, hints=("sig=",), confidence=0.85),
    Rule("PRIVATE_KEY", "Critical", r"(-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----)", "Private key (PEM)", refs=("NIST IA-5", "SOC2 CC6.7"), hints=("PRIVATE KEY-----",), confidence=0.99),
    Rule("JWT_TOKEN", "Medium", r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", "JSON web token", refs=("SOC2 CC6.7",), least_entropy=4.0, hints=("eyJ",), confidence=0.85),
    Rule("GITHUB_PAT", "Critical", r"(ghp_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{50,})", "GitHub personal access token", refs=("CIS 2.1.5", "NIST IA-5"), least_entropy=4.5, hints=("ghp_", "github_pat_"), confidence=0.98),
    Rule("GITLAB_TOKEN", "Critical", r"(glpat-[A-Za-z0-9_-]{20,})", "GitLab token", least_entropy=4.5, hints=("glpat-",), confidence=0.95),
    Rule("DATABASE_URL", "Critical", r"((?:postgres(?:ql)?|mysql|mongodb)(?:\+[a-z]+)?://[^\s:/@]+:[^\s:/@]+@[^\s\"']+)", "Database URL with credentials", refs=("NIST IA-5", "PCI-DSS Req 3"), least_entropy=3.0, hints=("://",), confidence=0.95),
    Rule("HARDCODED_PASSWORD", "High", r"(?i)(?:password|passwd|pwd)[\"']?\s*[:=]\s*[\"']?([^\s\"'<>${}]{6,})", "Hardcoded password", refs=("NIST IA-5", "SOC2 CC6.7"), least_entropy=3.5, hints=("password", "passwd", "pwd"), fold=True, validator="no_placeholder", confidence=0.75),
    Rule("ENV_VARIABLE_SECRET", "High", r"(?:SECRET_KEY|API_SECRET)\s*=\s*[\"']?([^\s\"']{8,})", "Secret in an environment variable", least_entropy=4.0, hints=("SECRET_KEY", "API_SECRET"), validator="no_placeholder", confidence=0.8),
    Rule("GENERIC_API_KEY", "Medium", r"(?i)api_?key[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9_-]{16,})", "Generic API key", least_entropy=4.5, hints=("api_key", "apikey"), fold=True, validator="no_placeholder", confidence=0.7),
    Rule("INTERNAL_IP", "Low", r"(?:^|[^0-9.])((?:10\.[0-9]{1,3}|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168)\.[0-9]{1,3}\.[0-9]{1,3})(?:[^0-9.]|$)", "Internal IP address", category=tables.INFRASTRUCTURE, refs=("NIST SC-7",), hints=("10.", "172.", "192.168."), confidence=0.8, recommendation="Remove internal addresses from public files."),
    Rule("SSH_CONFIG", "Medium", r"^\s*((?:Host|IdentityFile)\s+\S+)", "SSH configuration", category=tables.INFRASTRUCTURE, hints=("Host", "IdentityFile"), confidence=0.75, recommendation="Remove SSH configuration from public files."),
    Rule("EMAIL_ADDRESS", "Low", r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", "E-mail address", category=tables.PII, refs=("SOC2 CC6.7",), hints=("@",), confidence=0.8, recommendation="Remove personal data from public files."),
    Rule("CREDIT_CARD", "Critical", r"([0-9]+)", "Credit card number", category=tables.PII, refs=("PCI-DSS Req 3",), hints=(), validator="card", confidence=0.9, recommendation="Remove card numbers; they must not be stored in the clear."),
)
PLACEHOLDER = r"(?i)^(?:x+|\*+|changeme.*|example.*|placeholder.*|your[-_].*|password|secret|none|null|true|false|todo)$"
#: So many bits above a rule's entropy raise its severity by a level.
ESCALATION = 1.0


def _severity(rule: Rule, bits: Column) -> Column:
    order = list(tables.SEVERITIES)
    higher = order[max(0, order.index(rule.severity) - 1)]
    if rule.least_entropy is None or higher == rule.severity:
        return F.lit(rule.severity)
    return F.when(bits >= rule.least_entropy + ESCALATION, higher).otherwise(rule.severity)


def _valid(rule: Rule, match: Column) -> Column:
    if rule.validator == "card":
        return scalars.card_checked(match)
    if rule.validator == "no_placeholder":
        return ~match.rlike(PLACEHOLDER)
    return F.lit(True)


def _tried(rule: Rule, text: Column) -> Column:
    """A literal test that spares most texts the pattern. Without hints: a run of digits long enough for a card."""
    held = F.lower(text) if rule.fold else text
    if not rule.hints:
        return text.rlike("[0-9]{13}")
    test = F.lit(False)
    for hint in rule.hints:
        test = test | held.contains(hint)
    return test


def numbered_lines(contents: DataFrame, keep: Column | None = None) -> DataFrame:
    """One row per line, numbered from 1; with ``keep`` only lines that pass it. The row carries no other line."""
    line = F.posexplode(F.split(F.col("content"), "\n", -1))
    out = contents.select(*[c for c in contents.columns if c != "content"], line.alias("pos_", "line")).withColumn("line_number", F.col("pos_") + 1).drop("pos_")
    return out if keep is None else out.where(keep)


def _bits(match: Column) -> Column:
    return F.round(scalars.entropy(match), 6)


def _matches(k: int, rule: Rule) -> Column:
    """The rule's matches in ``line`` as structs; its pattern is tried only where its literals are, and a match is measured once."""

    def measured(m: Column) -> Column:
        return F.struct(m.alias("match"), (F.lit(None).cast("double") if rule.least_entropy is None else _bits(m)).alias("bits"))

    def described(x: Column, i: Column) -> Column:
        fixed = {"description": rule.description, "category": rule.category, "recommendation": rule.recommendation, "confidence": rule.confidence}
        refs = F.array(*[F.lit(r) for r in rule.refs]).cast("array<string>")
        f = {c: F.lit(v).alias(c) for c, v in fixed.items()}
        return F.struct(F.lit(k).alias("rule"), i.cast("int").alias("nth"), F.lit(rule.name).alias("name"), _severity(rule, x["bits"]).alias("severity"), x["match"].alias("match"), f["description"], f["category"], refs.alias("refs"), f["recommendation"], f["confidence"])

    tried = _tried(rule, F.col("line"))
    if rule.near:
        tried = tried & F.lower(F.col("line")).contains(rule.near)
    found = F.regexp_extract_all(F.col("line"), F.lit(rule.pattern), F.lit(1))
    good = F.transform(found if rule.validator is None else F.filter(found, lambda m: _valid(rule, m)), measured)
    if rule.least_entropy is not None:
        good = F.filter(good, lambda x: x["bits"] >= rule.least_entropy)
    return F.when(tried, F.transform(good, described))


def secrets(contents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of the rules. Contents without any rule's literal are dropped before they are split; each line is then tried once per rule whose literal it holds."""
    any_rule = lambda text: _any([_tried(r, text) for r in rules])
    lines = numbered_lines(contents.where(any_rule(F.col("content"))), any_rule(F.col("line")))
    kind = "array<struct<rule:int,nth:int,name:string,severity:string,match:string,description:string,category:string,refs:array<string>,recommendation:string,confidence:double>>"
    found = [_matches(k, rule).cast(kind) for k, rule in enumerate(rules)]
    hits = lines.withColumn("hit", F.explode(F.flatten(F.filter(F.array(*found), lambda x: x.isNotNull()))))
    return schema.finding(
        hits, file_name=scalars.url_filename(F.col("file_url")), category=F.col("hit.category"), rule_name=F.col("hit.name"), description=F.col("hit.description"), severity=F.col("hit.severity"), match=scalars.redact(F.col("hit.match")),
        recommendation=F.col("hit.recommendation"), compliance_refs=F.col("hit.refs"), confidence=F.col("hit.confidence"), scanner=F.lit("DETERMINISTIC"), seq=schema.sequence(F.col("ordinal"), F.col("line_number"), F.col("hit.rule"), F.col("hit.nth")),
    )


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def tokens(contents: DataFrame, least: int = 16, most: int = 512) -> DataFrame:
    """One row per token of a length that entropy is looked at for, with its line. Lines without so long a run are never split."""
    long_run = F.lit(r"(?U)[^\s=:\"',;<>()\[\]{}]{%d}" % least)
    lines = numbered_lines(contents.where(F.regexp_like(F.col("content"), long_run)), F.regexp_like(F.col("line"), long_run))
    split = lines.select("*", F.posexplode(F.split(F.col("line"), scalars.TOKEN_DELIMITERS, -1)).alias("token_number", "token")).drop("line")
    return split.where(F.length("token").between(least, most))


def entropy_hits(contents: DataFrame, threshold: float = 4.5) -> DataFrame:
    """Tokens of high entropy: the columns of contents but its text, line_number, token_number, token, entropy.

    Tests come in order of price, and entropy once: the value is computed only for what the cheap tests let through.
    """
    good = tokens(contents).where(~scalars.harmless(F.col("token")) & scalars.mixed_characters(F.col("token")) & scalars.may_reach(F.col("token"), threshold))
    return good.withColumn("entropy", F.round(scalars.entropy(F.col("token")), 6)).where(F.col("entropy") >= threshold)


def first_per_line(hits: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """The first hit of each line of a file, unless the line is flagged (file_url, line_number) already."""
    if flagged is not None:
        hits = hits.join(flagged.select("file_url", "line_number").distinct(), ["file_url", "line_number"], "left_anti")
    w = Window.partitionBy("file_url", "line_number").orderBy("token_number")
    return hits.withColumn("nth_", F.row_number().over(w)).where("nth_ = 1").drop("nth_")


def with_context(hits: DataFrame, contents: DataFrame, redacted: bool = True) -> DataFrame:
    """hits with ``context``, the line and its neighbours; with the token itself redacted unless told otherwise."""
    texts = contents.select("file_url", "content")
    both = hits.join(texts, "file_url")
    text = scalars.context(F.split(F.col("content"), "\n", -1), F.col("line_number"))
    return both.withColumn("context", F.replace(text, F.col("token"), scalars.redact(F.col("token"))) if redacted else text).drop("content")


def entropy_findings(contents: DataFrame, threshold: float = 4.5, flagged: DataFrame | None = None, context: bool = True) -> DataFrame:
    hits = first_per_line(entropy_hits(contents, threshold), flagged)
    hits = with_context(hits, contents) if context else hits
    return schema.finding(
        hits, file_name=scalars.url_filename(F.col("file_url")), category=F.lit(tables.SECRET), rule_name=F.lit("HIGH_ENTROPY_STRING"),
        description=tables.text("entropy", F.format_string("%.2f", F.bround("entropy", 2))), severity=F.lit("Low"), match=scalars.redact(F.col("token")),
        recommendation=tables.text("entropy_advice"), compliance_refs=F.array(F.lit("NIST IA-5")), confidence=F.lit(0.55), scanner=F.lit("EntropyHunter"),
        seq=schema.sequence(F.col("ordinal"), F.col("line_number"), F.lit(len(RULES)), F.col("token_number")),
    )


def scan(contents: DataFrame, threshold: float = 4.5, rules: tuple[Rule, ...] = RULES, context: bool = True) -> DataFrame:
    """All findings of a corpus of texts: rules, then for each line that no rule flags its first token of high entropy.

    The same as ``secrets`` with ``entropy_findings``, but as one narrow plan: a line's rules and tokens are looked at together, so
    neither the lines already flagged nor the first hit of a line need a shuffle, and texts are read once.
    """
    long_run = r"(?U)[^\s=:\"',;<>()\[\]{}]{16}"
    worth = lambda text: _any([_tried(r, text) for r in rules]) | text.rlike(long_run)
    rest = [c for c in contents.columns if c != "content"]
    split = contents.where(worth(F.col("content"))).select(*rest, F.split("content", "\n", -1).alias("lines_"))
    near = lambda i: F.substring(F.concat_ws("\n", F.get("lines_", i - 1), F.get("lines_", i), F.get("lines_", i + 1)), 1, 200)
    around = (lambda x, i: F.when(x.rlike(long_run), near(i))) if context else (lambda x, i: F.lit(None).cast("string"))
    numbered = split.select(*rest, F.explode(F.transform("lines_", lambda x, i: F.struct(x.alias("line"), (i + 1).alias("n"), around(x, i).alias("around")))).alias("l_"))
    lines = numbered.select(*rest, F.col("l_.line").alias("line"), F.col("l_.n").alias("line_number"), F.col("l_.around").alias("around_")).where(worth(F.col("line")))
    flagged = lines.withColumn("rules_", F.flatten(F.filter(F.array(*[_matches(k, r) for k, r in enumerate(rules)]), lambda x: x.isNotNull())))
    cheap = lambda t: F.length(t["token"]).between(16, 512) & ~scalars.harmless(t["token"]) & scalars.mixed_characters(t["token"]) & scalars.may_reach(t["token"], threshold)
    tokens_ = F.transform(F.split("line", scalars.TOKEN_DELIMITERS, -1), lambda t, i: F.struct(i.alias("nth"), t.alias("token")))
    measured = F.transform(F.filter(tokens_, cheap), lambda t: F.struct(t["nth"].alias("nth"), t["token"].alias("token"), _bits(t["token"]).alias("bits")))
    first = F.when((F.size("rules_") == 0) & F.col("line").rlike(long_run), F.get(F.filter(measured, lambda t: t["bits"] >= threshold), F.lit(0)))
    alone = flagged.withColumn("first_", first).where((F.size("rules_") > 0) | F.col("first_").isNotNull())
    bits = F.col("first_.bits")
    entropy = F.struct(
        F.lit(len(RULES)).alias("rule"), F.col("first_.nth").alias("nth"), F.lit("HIGH_ENTROPY_STRING").alias("name"), F.lit("Low").alias("severity"), F.col("first_.token").alias("match"), tables.text("entropy", F.format_string("%.2f", F.bround(bits, 2))).alias("description"),
        F.lit(tables.SECRET).alias("category"), F.array(F.lit("NIST IA-5")).alias("refs"), tables.text("entropy_advice").alias("recommendation"), F.lit(0.55).alias("confidence"),
    )
    hits = alone.select(*rest, "line_number", "around_", F.explode(F.when(F.col("first_").isNull(), F.col("rules_")).otherwise(F.array(entropy))).alias("hit"))
    is_entropy = F.col("hit.name") == "HIGH_ENTROPY_STRING"
    redacted = scalars.redact(F.col("hit.match"))
    return schema.finding(
        hits, file_name=scalars.url_filename(F.col("file_url")), category=F.col("hit.category"), rule_name=F.col("hit.name"), description=F.col("hit.description"), severity=F.col("hit.severity"), match=redacted,
        context=F.when(is_entropy, F.coalesce(F.replace("around_", F.col("hit.match"), redacted), F.lit(""))).otherwise(""), recommendation=F.col("hit.recommendation"), compliance_refs=F.col("hit.refs"), confidence=F.col("hit.confidence"),
        scanner=F.when(is_entropy, "EntropyHunter").otherwise("DETERMINISTIC"), seq=schema.sequence(F.col("ordinal"), F.col("line_number"), F.col("hit.rule"), F.col("hit.nth")),
    )
