"""The registered queries, with the same in DuckDB SQL.

The driver's tables have no listing, so documents stand in: a source is a container, a document a file with a suffix by its
number, its text the content. Pages are HTML listings. What the tables do not hold is given inline, on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions import scalars, tables
from quaymark.operators import ai, correlate, detect, exif, filters, misconfig, score
from quaymark.plans import report
from quaymark.sources import archives, listings

SUFFIXES = {".env": "Environment", ".json": "JSON", ".py": "Python", ".sql": "SQL / Database Dump", ".yml": "Configuration", ".pem": "Certificate / Key", ".txt": "Other", ".zip": "Archive", ".png": "Image", ".js": "JavaScript"}
THRESHOLD = 3.0


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(_table(spark, sf_dir, "documents"))


def _files(docs: DataFrame) -> DataFrame:
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("doc_id") % 10 + 1).cast("int"))
    base = F.concat(F.lit("https://"), F.col("source"), F.lit(".s3.us-east-1.amazonaws.com/"))
    rows = docs.select(F.col("doc_id").alias("ordinal"), base.alias("container_id"), F.concat(F.lit("d/"), F.col("doc_id").cast("string"), suffix).alias("key"), F.col("n_chars").alias("size_bytes"), F.col("text").alias("content"))
    return rows.withColumn("url", scalars.key_to_url(F.col("container_id"), F.col("key"))).withColumn("file_type", scalars.file_type(F.col("url")))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contents(files(spark, sf_dir))


def _contents(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("url").alias("file_url"), "file_type", "ordinal", "container_id", "content")


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = files(spark, sf_dir).select(F.col("container_id").alias("raw_url")).distinct()
    return misconfig.detected(urls.withColumns({"status": F.lit(200), "headers": F.create_map(F.lit("Server"), F.lit("AmazonS3")), "body": F.lit("")}))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.scan(contents(spark, sf_dir), THRESHOLD, context=False)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _bits(x: str) -> str:
    share = f"((length({x}) - length(replace({x}, c, '')))::DOUBLE / length({x}))"
    return f"round(coalesce(list_sum(list_transform(list_distinct(string_split({x}, '')), lambda c: -{share} * log2({share}))), 0), 6)"


def _luhn(x: str) -> str:
    d = f"CAST(substr({x}, i::INT, 1) AS INT)"
    return f"list_sum(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN (length({x}) - i) % 2 = 0 THEN {d} WHEN 2 * {d} > 9 THEN 2 * {d} - 9 ELSE 2 * {d} END)) % 10 = 0"


def _redacted(x: str) -> str:
    return f"CASE WHEN length({x}) <= 6 THEN '***' ELSE left({x}, 6) || '***' END"


SEPARATORS = r"""\s=:"'',;<>()\[\]{}"""
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
TYPES_SQL = "[" + ", ".join(map(_quoted, SUFFIXES.values())) + "]"
FILES_SQL = f"""files AS (
  SELECT doc_id AS ordinal, 'https://' || source || '.s3.us-east-1.amazonaws.com/' AS container_id, n_chars AS size_bytes, text AS content,
    'd/' || doc_id || ([{', '.join(map(_quoted, SUFFIXES))}])[doc_id % 10 + 1] AS key, {TYPES_SQL}[doc_id % 10 + 1] AS file_type,
    'https://' || source || '.s3.us-east-1.amazonaws.com/d/' || doc_id || ([{', '.join(map(_quoted, SUFFIXES))}])[doc_id % 10 + 1] AS url
  FROM documents
)"""
LINES_SQL = f"""{FILES_SQL}, lines AS (
  SELECT ordinal, url, container_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_number FROM files
)"""
TOKENS_SQL = f"""{LINES_SQL}, tokens AS (
  SELECT * FROM (SELECT ordinal, url, container_id, line, line_number, unnest(string_split_regex(line, '[{SEPARATORS}]+')) AS token, generate_subscripts(string_split_regex(line, '[{SEPARATORS}]+'), 1) - 1 AS token_number
    FROM lines WHERE regexp_matches(line, '[^{SEPARATORS}]{{16}}')) WHERE length(token) BETWEEN 16 AND 512
), good AS (
  SELECT * FROM tokens WHERE NOT regexp_matches(token, {_quoted(tables.HARMLESS_TOKENS)}) AND len(list_distinct(string_split(token, '')))::DOUBLE / length(token) >= 0.3
    AND regexp_matches(token, '\\p{{Lu}}')::INT + regexp_matches(token, '\\p{{Ll}}')::INT + regexp_matches(token, '\\p{{Nd}}')::INT + regexp_matches(token, '[^\\p{{L}}\\p{{N}}]')::INT >= 2
), hits AS (SELECT *, {_bits('token')} AS entropy FROM good)"""


def _rule_sql(k: int, rule: detect.Rule, source: str, rest: str) -> str:
    """A rule's matches in the lines of a table, with its other columns ``rest``."""
    order = list(tables.SEVERITIES)
    higher = order[max(0, order.index(rule.severity) - 1)]
    near = [f"contains(lower(line), {_quoted(rule.near)})"] if rule.near else []
    hints = [f"contains({'lower(line)' if rule.fold else 'line'}, {_quoted(h)})" for h in rule.hints]
    held = near + (["(" + " OR ".join(hints) + ")"] if hints else [])
    tests = [f"{_bits('m')} >= {rule.least_entropy}"] if rule.least_entropy is not None else []
    tests += [f"length(m) BETWEEN 13 AND 19 AND {_luhn('m')}"] if rule.validator == "card" else [f"NOT regexp_matches(m, {_quoted(detect.PLACEHOLDER)})"] if rule.validator else []
    severity = _quoted(rule.severity) if rule.least_entropy is None else f"CASE WHEN {_bits('m')} >= {rule.least_entropy + detect.ESCALATION} THEN '{higher}' ELSE '{rule.severity}' END"
    found = f"regexp_extract_all(line, {_quoted(rule.pattern)}, 1)"
    refs = "[" + ", ".join(map(_quoted, rule.refs)) + "]" + ("" if rule.refs else "::VARCHAR[]")
    fixed = f"{_quoted(rule.category)} AS category, {_quoted(rule.description)} AS description, {refs} AS refs, {_quoted(rule.recommendation)} AS recommendation, {rule.confidence}::DOUBLE AS confidence, 'DETERMINISTIC' AS scanner"
    return f"SELECT {rest}, {k} AS rule, nth, '{rule.name}' AS rule_name, {severity} AS severity, {_redacted('m')} AS match, {fixed} FROM (SELECT {rest}, unnest({found}) AS m, generate_subscripts({found}, 1) AS nth FROM {source} WHERE {' AND '.join(held) or 'true'}) WHERE {' AND '.join(tests) or 'true'}"


FINDINGS_SQL = f"""{TOKENS_SQL}, ruled AS ({' UNION ALL '.join(_rule_sql(k, r, 'lines', 'ordinal, url, container_id, line_number') for k, r in enumerate(detect.RULES))}),
alone AS (
  SELECT h.* FROM hits h LEFT JOIN (SELECT DISTINCT url, line_number FROM ruled) r ON h.url = r.url AND h.line_number = r.line_number
  WHERE r.url IS NULL AND entropy >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY h.url, h.line_number ORDER BY token_number) = 1
), findings AS (
  SELECT * FROM ruled
  UNION ALL SELECT ordinal, url, container_id, line_number, {len(detect.RULES)}, token_number, 'HIGH_ENTROPY_STRING', 'Low', {_redacted('token')}, 'Secret Exposure', 'High-entropy string detected (entropy=' || printf('%.2f', entropy) || ') — possible undiscovered secret', ['NIST IA-5'], {_quoted(tables.TEXTS['entropy_advice'])}, 0.55, 'EntropyHunter' FROM alone
)"""
WEIGHT_SQL = "CASE severity " + " ".join(f"WHEN '{s}' THEN {v[1]}" for s, v in tables.SEVERITIES.items()) + " END"
MULT_SQL = "CASE category " + " ".join(f"WHEN {_quoted(c)} THEN {m}" for c, m in tables.CATEGORIES.items()) + " END"
RANK_SQL = "CASE severity " + " ".join(f"WHEN '{s}' THEN {v[0]}" for s, v in tables.SEVERITIES.items()) + " END"
RAW_SQL = f"10 * (1 - exp(-sum(CAST({WEIGHT_SQL} * {MULT_SQL} AS DECIMAL(10,2)))::DOUBLE / 8))"
FLOOR_SQL = f"bool_or(severity = 'Critical' AND rule_name IN ({', '.join(map(_quoted, tables.FLOOR_RULES))}))"
RISK_SQL = f"CASE WHEN count(*) = 0 THEN 2.0 ELSE round(least(CASE WHEN {FLOOR_SQL} THEN greatest({RAW_SQL}, 8.5) ELSE {RAW_SQL} END, 10.0), 2) END"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _values(rows: list[tuple], names: str) -> str:
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else _quoted(v) if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS t({names})"


# Scalars


@query(f"WITH {TOKENS_SQL} SELECT ordinal, line_number::BIGINT AS line_number, token_number::BIGINT AS token_number, token, {_bits('token')} AS entropy FROM tokens")
def token_entropy(spark, sf_dir):
    rows = detect.tokens(contents(spark, sf_dir))
    return rows.select("ordinal", F.col("line_number").cast("long").alias("line_number"), F.col("token_number").cast("long").alias("token_number"), "token", F.round(scalars.entropy(F.col("token")), 6).alias("entropy"))


@query(f"WITH {TOKENS_SQL} SELECT ordinal, {_redacted('token')} AS redacted, substr(sha256(token), 1, 16) AS fingerprint, count(*) AS n FROM tokens GROUP BY ALL")
def redact_tokens(spark, sf_dir):
    rows = detect.tokens(contents(spark, sf_dir))
    return rows.groupBy("ordinal", scalars.redact(F.col("token")).alias("redacted"), scalars.fingerprint(F.col("token")).alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FILES_SQL} SELECT key, 'd/' || key AS d, regexp_extract(key, '([^/]*)$', 1) AS name, lower(regexp_extract(key, '(\\.[^./]+)$', 1)) AS extension FROM files")
def url_filename(spark, sf_dir):
    rows = files(spark, sf_dir)
    return rows.select("key", F.concat(F.lit("d/"), F.col("key")).alias("d"), scalars.url_filename(F.concat("url", F.lit("?v=1#x"))).alias("name"), scalars.extension(F.col("key")).alias("extension"))


@query("SELECT doc_id, CASE WHEN n_chars * 37 < 1024 THEN printf('%.1f B', n_chars * 37.0) WHEN n_chars * 37 < 1048576 THEN printf('%.1f KB', (n_chars * 37 // 1024)::DOUBLE) ELSE printf('%.1f MB', (n_chars * 37 // 1048576)::DOUBLE) END AS size FROM documents")
def human_size(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", scalars.human_size(F.col("n_chars") * 37).alias("size"))


@query(f"WITH {FILES_SQL} SELECT ordinal, file_type, file_type NOT IN ('Archive', 'Image', 'Document', 'Binary') AS is_text FROM files")
def classify_files(spark, sf_dir):
    return files(spark, sf_dir).select("ordinal", "file_type", scalars.is_text(F.col("file_type")).alias("is_text"))


@query("SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE left(text, 40) || ' … ' || right(text, 40) END AS short, regexp_replace(left(text, 30), '[^\\p{L}\\p{N}._-]', '_', 'g') AS safe FROM documents")
def truncated_texts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", scalars.truncate(F.col("text")).alias("short"), scalars.safe_filename(F.substring("text", 1, 30)).alias("safe"))


NAMES = [(".env", "Environment"), ("prod.env", "Environment"), (".env.local", "Other"), ("Dockerfile", "Configuration"), ("a.tar.gz", "Archive"), ("id_rsa", "Certificate / Key"), ("x/y/settings.PY?v=2", "Python"), ("a;b.js", "Other"), ("noext", "Other"), ("b.tfvars#z", "Terraform"), ("https://h/d/.npmrc", "Environment")]


@query(f"SELECT * FROM {_values(NAMES, 'name, file_type')}")
def classify_inline(spark, sf_dir):
    return spark.createDataFrame([(n,) for n, _ in NAMES], "name string").select("name", scalars.file_type(F.col("name")).alias("file_type"))


VERSIONS = [("1.0.2", "1.0.10", -1), ("v2.0", "2.0", 0), ("1.2", "1.2.0", -1), ("2.0rc1", "1.0", -1), ("3", "2.9.9", 1), ("x", "y", 0)]


@query(f"SELECT a, b, c::BIGINT AS c FROM {_values(VERSIONS, 'a, b, c')}")
def version_compare(spark, sf_dir):
    return spark.createDataFrame([v[:2] for v in VERSIONS], "a string, b string").select("a", "b", scalars.version_compare(F.col("a"), F.col("b")).cast("long").alias("c"))


KEYS = [("openai", "sk-" + "a" * 20, True), ("openai", "sk-a", False), ("claude", "sk-ant-" + "b" * 40, True), ("gemini", "AIz", False), ("ollama", "", True)]


@query(f"SELECT * FROM {_values(KEYS, 'provider, key, ok')}")
def key_formats(spark, sf_dir):
    return spark.createDataFrame(KEYS, "provider string, key string, ok boolean").select("provider", "key", scalars.key_format_ok(F.col("provider"), F.col("key")).alias("ok"))


@query("SELECT event_id, round((epoch_us(ts) - epoch_us(min(ts) OVER ())) / 1e6, 2) AS seconds FROM events")
def elapsed_times(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", "ts")
    first = F.broadcast(rows.agg(F.min("ts").alias("first_")))  # one row
    return rows.join(first, F.lit(True)).select("event_id", scalars.elapsed(F.col("first_"), F.col("ts")).alias("seconds"))


BANDS = [(0, 0, 0, 1.9, "LOW", "green"), (0, 0, 4, 4.0, "MODERATE", "amber"), (0, 1, 0, 6.99, "MODERATE", "amber"), (0, 3, 0, 7.0, "HIGH", "red"), (1, 0, 0, 9.5, "CRITICAL", "red")]


@query(f"SELECT c::BIGINT AS c, h::BIGINT AS h, m::BIGINT AS m, s::DOUBLE AS s, rating, band FROM {_values(BANDS, 'c, h, m, s, rating, band')}")
def ratings(spark, sf_dir):
    rows = spark.createDataFrame([b[:4] for b in BANDS], "c long, h long, m long, s double")
    return rows.withColumns({"rating": scalars.exposure_rating(F.col("c"), F.col("h"), F.col("m")), "band": scalars.risk_band(F.col("s"))})


@query("SELECT lat_d, lon_d, printf('%.5f, %.5f', lat_d + 51 / 60.0 + 30 / 3600.0, -(lon_d + 17 / 60.0 + 40 / 3600.0)) AS place FROM (SELECT (doc_id % 90)::DOUBLE AS lat_d, (doc_id % 180)::DOUBLE AS lon_d FROM documents)")
def gps_decimal(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select((F.col("doc_id") % 90).cast("double").alias("lat_d"), (F.col("doc_id") % 180).cast("double").alias("lon_d"))
    part = lambda d, m, s, ref: F.struct(F.col(d).alias("d"), F.lit(m).alias("m"), F.lit(s).alias("s"), F.lit(ref).alias("ref"))
    return rows.withColumn("gps", F.struct(part("lat_d", 51.0, 30.0, "N").alias("lat"), part("lon_d", 17.0, 40.0, "W").alias("lon"))).select("lat_d", "lon_d", exif.position().alias("place"))


# Filters


@query(f"WITH {FILES_SQL} SELECT ordinal, key FROM files WHERE NOT regexp_matches(key, '\\.png$') AND size_bytes <= 4000 AND NOT contains(key, '13')")
def include_filter(spark, sf_dir):
    return filters.included(files(spark, sf_dir), max_bytes=4000, ignored=(*tables.IGNORED, "13")).select("ordinal", "key")


@query(f"WITH {FILES_SQL} SELECT ordinal, CASE WHEN file_type = 'Image' THEN 'image' WHEN file_type = 'Archive' THEN 'archive' WHEN size_bytes > 4000 THEN 'skip_size' ELSE 'text' END AS route FROM files")
def route_files(spark, sf_dir):
    return filters.routed(files(spark, sf_dir), max_bytes=4000).select("ordinal", "route")


@query(f"WITH {FILES_SQL}, r AS (SELECT container_id, CASE WHEN file_type = 'Image' THEN 'image' WHEN file_type = 'Archive' THEN 'archive' WHEN size_bytes > 4000 THEN 'skip' ELSE 'text' END AS route FROM files) SELECT container_id, count(*) AS total_files, count(*) FILTER (route = 'text') AS scanned_files, count(*) FILTER (route = 'skip') AS skipped_files, count(*) FILTER (route = 'archive') AS archive_files FROM r GROUP BY 1")
def run_counters(spark, sf_dir):
    return score.run_counters(filters.routed(files(spark, sf_dir), max_bytes=4000), "container_id")


@query(f"WITH {TOKENS_SQL} SELECT ordinal, line_number::BIGINT AS line_number, token_number::BIGINT AS token_number, token FROM good")
def entropy_fp_filter(spark, sf_dir):
    rows = detect.tokens(contents(spark, sf_dir)).where(~scalars.harmless(F.col("token")) & scalars.mixed_characters(F.col("token")))
    return rows.select("ordinal", F.col("line_number").cast("long").alias("line_number"), F.col("token_number").cast("long").alias("token_number"), "token")


@query(f"WITH {FINDINGS_SQL} SELECT url AS file_url, rule_name, match, line_number::BIGINT AS line_number FROM findings WHERE {RANK_SQL} >= 2")
def min_severity_filter(spark, sf_dir):
    return filters.at_least(findings(spark, sf_dir), "Medium").select("file_url", "rule_name", "match", F.col("line_number").cast("long").alias("line_number"))


# Detectors


@query(f"WITH {TOKENS_SQL} SELECT ordinal, line_number::BIGINT AS line_number, token_number::BIGINT AS token_number, token, entropy FROM hits WHERE entropy >= 3.0")
def entropy_hits(spark, sf_dir):
    rows = detect.entropy_hits(contents(spark, sf_dir), 3.0)
    return rows.select("ordinal", F.col("line_number").cast("long").alias("line_number"), F.col("token_number").cast("long").alias("token_number"), "token", "entropy")


@query(f"WITH {FINDINGS_SQL} SELECT ordinal, line_number::BIGINT AS line_number, token, entropy FROM alone")
def entropy_first_per_line(spark, sf_dir):
    texts = contents(spark, sf_dir)
    rows = detect.first_per_line(detect.entropy_hits(texts, THRESHOLD), detect.secrets(texts))
    return rows.select("ordinal", F.col("line_number").cast("long").alias("line_number"), "token", "entropy")


@query(f"WITH {TOKENS_SQL}, h AS (SELECT * FROM hits WHERE entropy >= 3.0 QUALIFY row_number() OVER (PARTITION BY url, line_number ORDER BY token_number) = 1) SELECT h.ordinal, h.line_number::BIGINT AS line_number, replace(left((SELECT string_agg(l.line, chr(10) ORDER BY l.line_number) FROM lines l WHERE l.url = h.url AND l.line_number BETWEEN h.line_number - 1 AND h.line_number + 1), 200), h.token, {_redacted('h.token')}) AS context FROM h")
def line_context(spark, sf_dir):
    texts = contents(spark, sf_dir)
    rows = detect.with_context(detect.first_per_line(detect.entropy_hits(texts, 3.0)), texts)
    return rows.select("ordinal", F.col("line_number").cast("long").alias("line_number"), "context")


@query("SELECT conv_id, turn, left(concat_ws(chr(10), lag(text) OVER w, text, lead(text) OVER w), 200) AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def window_context(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_url"), F.col("turn").alias("line_number"), F.col("text").alias("line"))
    return score.windowed_context(rows).select(F.col("file_url").alias("conv_id"), F.col("line_number").alias("turn"), "context")


@query(f"WITH {FINDINGS_SQL} SELECT ordinal, line_number::BIGINT AS line_number, match FROM findings WHERE rule_name = 'EMAIL_ADDRESS'")
def rule_email(spark, sf_dir):
    rules = tuple(r for r in detect.RULES if r.name == "EMAIL_ADDRESS")
    return detect.secrets(contents(spark, sf_dir), rules).select(F.col("seq.file").alias("ordinal"), F.col("line_number").cast("long").alias("line_number"), "match")


@query(f"WITH {FINDINGS_SQL} SELECT ordinal, line_number::BIGINT AS line_number, match FROM findings WHERE rule_name = 'CREDIT_CARD'")
def rule_credit_card(spark, sf_dir):
    rules = tuple(r for r in detect.RULES if r.name == "CREDIT_CARD")
    return detect.secrets(contents(spark, sf_dir), rules).select(F.col("seq.file").alias("ordinal"), F.col("line_number").cast("long").alias("line_number"), "match")


IP = r"([0-9]{1,3}(?:\.[0-9]{1,3}){3})"


@query(f"WITH {LINES_SQL} SELECT ordinal, line_number::BIGINT AS line_number, ip, regexp_matches(ip, '^(10\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)') AS internal FROM (SELECT *, unnest(regexp_extract_all(line, '{IP}', 1)) AS ip FROM lines)")
def rule_ipv4_any(spark, sf_dir):
    lines = detect.numbered_lines(contents(spark, sf_dir), F.col("line").rlike(IP))
    rows = lines.select("ordinal", F.col("line_number").cast("long").alias("line_number"), F.explode(F.regexp_extract_all("line", F.lit(IP), F.lit(1))).alias("ip"))
    return rows.withColumn("internal", F.col("ip").rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)"))


def _mixed(n: int, seed: int, alphabet: str) -> str:
    """n characters without a meaning; the alphabet is walked with a stride, so all of it occurs in time."""
    return "".join(alphabet[(seed + 37 * i) % len(alphabet)] for i in range(n))


UPPER, WIDE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: Lines that fire each rule, made from parts so that none of them is a credential's literal.
SAMPLES = [
    "id = AKI" + "A" + _mixed(16, 1, UPPER), "aws_secret_access_key = " + _mixed(40, 2, WIDE), "aws_session_token = " + _mixed(120, 3, WIDE), "k: AIz" + "a" + _mixed(35, 4, WIDE), '{"private_' + 'key": "' + _mixed(64, 5, WIDE) + '"}', "t ya29" + "." + _mixed(60, 6, WIDE),
    "Account" + "Key=" + _mixed(64, 7, WIDE) + "==;", "https://h/c?sv=1&si" + "g=" + _mixed(40, 8, WIDE), "-----BEGIN RSA PRIV" + "ATE KEY-----", "jwt ey" + "J" + _mixed(20, 9, WIDE) + "." + _mixed(30, 10, WIDE) + "." + _mixed(30, 11, WIDE), "gh" + "p_" + _mixed(36, 12, WIDE), "glp" + "at-" + _mixed(32, 13, WIDE),
    "postgresql" + "://user:" + _mixed(12, 14, WIDE) + "@db/prod", "pass" + "word = '" + _mixed(18, 15, WIDE) + "'", "SECRET" + "_KEY=" + _mixed(30, 16, WIDE), "api" + "_key: " + _mixed(40, 17, WIDE), "host 192.168.1.17 and 10.0.0.1, not 8.8.8.8", "  IdentityFile ~/.ssh/x", "Host bastion", "mail bob@example.org, eve@x.co", "card 4111111111111111 not 4111111111111112",
    "pass" + "word = changeme123", "nothing here", "password = short",
]
INLINE = [(i, s) for i, s in enumerate(SAMPLES)]


@query(f"WITH inline AS (SELECT id::BIGINT AS id, line FROM {_values(INLINE, 'id, line')}) " + " UNION ALL ".join(f"SELECT id, rule_name, severity, match FROM ({_rule_sql(k, r, 'inline', 'id')})" for k, r in enumerate(detect.RULES)))
def rule_all_inline(spark, sf_dir):
    rows = spark.createDataFrame([(i, str(i), "Other", s) for i, s in INLINE], "ordinal long, file_url string, file_type string, content string")
    return detect.secrets(rows).select(F.col("seq.file").alias("id"), "rule_name", "severity", "match")


@query(f"WITH {FINDINGS_SQL} SELECT d.lang, f.rule_name, count(*) AS n FROM findings f JOIN documents d ON d.doc_id = f.ordinal GROUP BY 1, 2")
def rule_hits_by_lang(spark, sf_dir):
    lang = _table(spark, sf_dir, "documents").select(F.col("doc_id"), "lang")
    return findings(spark, sf_dir).select(F.col("seq.file").alias("doc_id"), "rule_name").join(lang, "doc_id").groupBy("lang", "rule_name").agg(F.count(F.lit(1)).alias("n"))


TURNS = [(-1, 0, "write to ann@example.org, or b.c@x.example"), (-1, 1, "no address"), (-2, 0, "a@b")]


@query(f"WITH c AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT conv_id::BIGINT, turn::BIGINT, text FROM {_values(TURNS, 'conv_id, turn, text')}), l AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '{EMAIL}')) AS m FROM c) SELECT conv_id, turn, {_redacted('m')} AS match FROM l")
def conversation_emails(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").unionByName(spark.createDataFrame(TURNS, "conv_id long, turn long, text string"))
    rows = turns.select(F.concat_ws("/", "conv_id", "turn").alias("file_url"), F.lit("Other").alias("file_type"), F.col("conv_id").alias("ordinal"), "turn", F.col("text").alias("content"))
    found = detect.secrets(rows, tuple(r for r in detect.RULES if r.name == "EMAIL_ADDRESS"))
    return found.select(F.col("seq.file").alias("conv_id"), F.substring_index("file_url", "/", -1).cast("long").alias("turn"), "match")


# Misconfiguration


@query("SELECT DISTINCT 'https://' || source || '.s3.us-east-1.amazonaws.com/' AS file_url, source AS file_name, 'PUBLIC_BUCKET_ACCESS' AS rule_name, 'Critical' AS severity, '[AWS S3]' AS match FROM documents")
def public_bucket(spark, sf_dir):
    return misconfig.public_containers(containers(spark, sf_dir)).select("file_url", "file_name", "rule_name", "severity", "match")


PATTERNS_SQL = _values([(i, p, misconfig.rule_of(p), label, s) for i, (p, label, s) in enumerate(tables.SENSITIVE_NAMES)], "i, pattern, rule_name, label, severity")


@query(f"WITH {FILES_SQL} SELECT container_id, rule_name, severity, label || ' (' || arg_min(key, ordinal) || ') is publicly accessible in cloud storage.' AS description FROM files JOIN {PATTERNS_SQL} ON regexp_matches(lower(key), pattern) GROUP BY container_id, i, rule_name, label, severity")
def sensitive_inventory(spark, sf_dir):
    rows = misconfig.sensitive_findings(containers(spark, sf_dir), files(spark, sf_dir))
    return rows.select(F.col("file_url").alias("container_id"), "rule_name", "severity", "description")


HOSTS = [
    ("https://b.s3.us-east-1.amazonaws.com/", 200, None, "", "AWS S3", "b", "us-east-1"), ("https://b.s3.amazonaws.com/", 200, None, "", "AWS S3", "b", ""), ("https://s3-eu-west-1.amazonaws.com/", 206, None, "", "AWS S3", "", "eu-west-1"),
    ("https://x.cloudfront.net/a", 200, None, "", "CloudFront (CDN)", "", ""), ("https://bkt.storage.googleapis.com/", 200, None, "<ListBucketResult><Name>n</Name></ListBucketResult>", "Google Cloud Storage", "bkt", ""), ("https://acct.blob.core.windows.net/c", 200, None, "", "Azure Blob Storage", "acct", ""),
    ("https://h.example/", 200, "x-amz-request-id", "", "AWS S3", "", ""), ("https://h.example/l", 200, None, '<?xml version="1.0"?><ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/"><Name>b1</Name></ListBucketResult>', "AWS S3", "b1", ""),
    ("https://h.example/az", 200, None, '<EnumerationResults ServiceEndpoint="https://a.blob.core.windows.net/cont/"><Blobs/></EnumerationResults>', "Azure Blob Storage", "cont", ""), ("https://h.example/i", 200, None, "<html><title>Index of /</title></html>", "Open Directory Listing", "", ""), ("https://h.example/w", 200, None, '<p><a href="x">x</a>', "Generic Web File Listing", "", ""), ("https://h.example/u", 404, None, "none", "Unknown", "", ""),
]


@query(f"SELECT raw_url, container_type, container_name, region, status = 200 AS is_public FROM {_values([(u, s, t, n, r) for u, s, _, _, t, n, r in HOSTS], 'raw_url, status, container_type, container_name, region')}")
def container_detect(spark, sf_dir):
    rows = spark.createDataFrame([(u, s, {h.upper(): "1"} if h else {}, b) for u, s, h, b, *_ in HOSTS], "raw_url string, status int, headers map<string,string>, body string")
    return misconfig.detected(rows).select("raw_url", "container_type", "container_name", "region", "is_public")


# Correlation


DUPLICATES_SQL = """SELECT arg_min(url, (ordinal, line_number, rule, nth)) AS file_url, 'DUPLICATE_SECRET:' || arg_min(rule_name, (ordinal, line_number, rule, nth)) AS rule_name,
  'The same secret value (' || arg_min(rule_name, (ordinal, line_number, rule, nth)) || ') was found in ' || count(DISTINCT url) || ' different files: '
  || array_to_string(list_sort(list_distinct(list(regexp_extract(url, '([^/]*)$', 1))))[1:5], ', ') || CASE WHEN count(DISTINCT url) > 5 THEN '...' ELSE '' END AS description
FROM findings GROUP BY substr(sha256(match), 1, 16) HAVING """


@query(f"WITH {FINDINGS_SQL} {DUPLICATES_SQL} count(*) >= 2")
def duplicate_secrets(spark, sf_dir):
    return correlate.duplicates(findings(spark, sf_dir)).select("file_url", "rule_name", "description")


@query(f"WITH {FINDINGS_SQL} {DUPLICATES_SQL} count(DISTINCT url) >= 2")
def duplicate_secrets_strict(spark, sf_dir):
    return correlate.duplicates(findings(spark, sf_dir), strict=True).select("file_url", "rule_name", "description")


@query(f"WITH {FINDINGS_SQL} SELECT min(url) AS file_url, 'CREDENTIAL_REUSE:' || rule_name AS rule_name, '[' || count(DISTINCT url) || ' files affected]' AS match FROM findings GROUP BY findings.rule_name HAVING count(DISTINCT url) >= 3")
def credential_reuse(spark, sf_dir):
    return correlate.reuse(findings(spark, sf_dir)).select("file_url", "rule_name", "match")


def _some_sql(rules: tuple[str, ...], value: str) -> str:
    return f"list_sort(list_distinct(coalesce(list({value}) FILTER (split_part(rule_name, ':', -1) IN ({', '.join(map(_quoted, rules))})), [])))"


SURFACE_SQL = f"""s AS (
  SELECT container_id, {_some_sql(tables.CREDENTIAL_RULES, "trim(split_part(description, '(', 1))")} AS credentials, {_some_sql(tables.PII_RULES, 'description')} AS pii, {_some_sql(tables.INFRASTRUCTURE_RULES, 'description')} AS infra,
    arg_max(severity, {RANK_SQL}) AS highest_severity FROM findings GROUP BY 1
), g AS (SELECT container_id, string_agg(framework, ',' ORDER BY first_at) AS gaps FROM (SELECT container_id, split_part(ref, ' ', 1) AS framework, min((ordinal, line_number, rule, nth, pos)) AS first_at FROM (SELECT *, unnest(refs) AS ref, generate_subscripts(refs, 1) AS pos FROM findings) GROUP BY 1, 2) GROUP BY 1)
SELECT s.container_id, array_to_string(credentials, ',') AS credentials, array_to_string(pii, ',') AS pii, array_to_string(infra, ',') AS infra, highest_severity, 2.0 * len(credentials) + 1.5 * len(pii) + 0.5 * len(infra) AS total_exposure_score, coalesce(gaps, '') AS gaps,
  CASE WHEN len(credentials) + len(pii) + len(infra) = 0 THEN 'No significant exposure surface' ELSE concat_ws(' | ', CASE WHEN len(credentials) > 0 THEN 'Credentials: ' || array_to_string(credentials[1:5], ', ') END,
    CASE WHEN len(pii) > 0 THEN 'PII: ' || array_to_string(pii, ', ') END, CASE WHEN len(infra) > 0 THEN 'Infrastructure: ' || array_to_string(infra[1:3], ', ') END) END AS summary
FROM s LEFT JOIN g USING (container_id)"""


def _surface(rows: DataFrame) -> DataFrame:
    joined = lambda c, name: F.array_join(c, ",").alias(name)
    return rows.select("container_id", joined("credential_types", "credentials"), joined("pii_categories", "pii"), joined("infra_details", "infra"), "highest_severity", "total_exposure_score", joined("compliance_gaps", "gaps"), "summary")


@query(f"WITH {FINDINGS_SQL}, {SURFACE_SQL}")
def exposure_surface(spark, sf_dir):
    return _surface(correlate.exposure_surface(findings(spark, sf_dir), "container_id"))


INLINE_FILES_SQL = f"""files AS (SELECT id::BIGINT AS ordinal, 'c' || (id % 3) AS container_id, length(line) AS size_bytes, line AS content, 'u' || id AS url, 'Other' AS file_type FROM {_values(INLINE, 'id, line')}), lines AS ("""


def _inline_findings(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(i, f"u{i}", "Other", f"c{i % 3}", s) for i, s in INLINE], "ordinal long, file_url string, file_type string, container_id string, content string")
    return detect.scan(rows, THRESHOLD, context=False)


def _inline_sql(sql: str) -> str:
    """The SQL over the documents' findings, over the inline lines' instead."""
    return INLINE_FILES_SQL + sql.partition("lines AS (")[2]


@query(f"WITH {_inline_sql(FINDINGS_SQL)}, {SURFACE_SQL}")
def exposure_inline(spark, sf_dir):
    return _surface(correlate.exposure_surface(_inline_findings(spark), "container_id"))


@query(f"WITH {_inline_sql(FINDINGS_SQL)} SELECT container_id, count(*) AS findings, {RISK_SQL} AS risk_score FROM findings GROUP BY 1")
def risk_all_rules(spark, sf_dir):
    return score.risk(_inline_findings(spark), "container_id")


# Scores


@query(f"WITH {FINDINGS_SQL} SELECT count(*) AS findings, {RISK_SQL} AS risk_score FROM findings")
def risk_score(spark, sf_dir):
    return score.risk(findings(spark, sf_dir))


@query(f"WITH {FINDINGS_SQL} SELECT container_id, count(*) AS findings, {RISK_SQL} AS risk_score, count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'Low') AS low FROM findings GROUP BY 1")
def risk_by_source(spark, sf_dir):
    return score.risk(findings(spark, sf_dir), "container_id", count=("Critical", "Low"))


SCORED = [(1, "Critical", "Secret Exposure", "AWS_ACCESS_KEY", 8.5), *[(2, "High", "Credential File Exposed", "X", 9.29)] * 5, *[(2, "Medium", "Public Access Misconfiguration", "Y", 9.29)] * 10, (3, "Critical", "Public Access Misconfiguration", "PUBLIC_BUCKET_ACCESS", 3.62), (4, "Critical", "Secret Exposure", "DUPLICATE_SECRET:AWS_ACCESS_KEY", 5.28)]


@query(f"SELECT DISTINCT id::BIGINT AS id, score::DOUBLE AS risk_score FROM {_values([(a, e) for a, _, _, _, e in SCORED], 'id, score')}")
def risk_inline(spark, sf_dir):
    rows = spark.createDataFrame([s[:4] for s in SCORED], "id long, severity string, category string, rule_name string")
    return score.risk(rows, "id").select("id", "risk_score")


@query(f"WITH {FINDINGS_SQL} SELECT s.severity, s.position::BIGINT AS position, count(f.url) AS n FROM {_values([(s, 4 - v[0]) for s, v in tables.SEVERITIES.items()], 'severity, position').replace(' AS t(', ' AS s(')} LEFT JOIN findings f ON f.severity = s.severity GROUP BY 1, 2")
def severity_counts(spark, sf_dir):
    return score.severity_table(findings(spark, sf_dir)).withColumn("position", F.col("position").cast("long"))


@query(f"WITH {FINDINGS_SQL} SELECT category, count(*) AS n FROM findings GROUP BY 1 ORDER BY n DESC, min((ordinal, line_number, rule, nth)) LIMIT 3")
def category_top3(spark, sf_dir):
    return score.top_categories(findings(spark, sf_dir))


@query(f"WITH {FINDINGS_SQL} SELECT ref, array_to_string(list_sort(list_distinct(list(rule_name)))[1:3], ', ') AS rules FROM (SELECT unnest(refs) AS ref, rule_name FROM findings) GROUP BY 1")
def compliance_map(spark, sf_dir):
    return score.compliance_map(findings(spark, sf_dir))


@query(f"WITH {FINDINGS_SQL} SELECT array_to_string(list_sort(list_distinct(list(rule_name) FILTER (severity = 'Critical')))[1:4], ', ') AS rules FROM findings")
def critical_rules(spark, sf_dir):
    return score.critical_rules(findings(spark, sf_dir)).select(F.array_join("rules", ", ").alias("rules"))


@query(f"WITH {FINDINGS_SQL} SELECT CASE WHEN bool_or(severity IN ('Critical', 'High')) THEN 2 ELSE 0 END::BIGINT AS exit_code FROM findings")
def exit_flag(spark, sf_dir):
    return score.exit_code(findings(spark, sf_dir)).select(F.col("exit_code").cast("long").alias("exit_code"))


@query(f"WITH {FINDINGS_SQL} SELECT url AS file_url, rule_name, severity, match, line_number::BIGINT AS line_number, row_number() OVER (ORDER BY {RANK_SQL} DESC, ordinal, line_number, rule, nth, rule_name) AS position FROM findings")
def sorted_findings(spark, sf_dir):
    rows = score.positioned(findings(spark, sf_dir))
    return rows.select("file_url", "rule_name", "severity", "match", F.col("line_number").cast("long").alias("line_number"), "position")


KEYWORD_SQL = " + ".join(f"(length(low) - length(replace(low, '{k}', ''))) // {len(k)}" for k in tables.KEYWORDS)
COARSE = r"""\s=:"'',"""


@query(f"""WITH {FINDINGS_SQL}, t AS (
  SELECT url, lower(content) AS low, length(content) AS n, greatest(len(list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '')), 1) AS words, len(string_split(content, chr(10))) AS n_lines,
    len(list_filter(string_split(content, chr(10)), lambda x: len(list_filter(string_split_regex(x, '[{COARSE}]+'), lambda y: length(y) > 15 AND {_bits('y')} > 4.5)) > 0)) AS loud FROM files
), c AS (SELECT url, count(*) FILTER (severity = 'Critical') AS crit, count(*) FILTER (severity = 'High') AS high FROM findings GROUP BY 1),
x AS (SELECT t.url, loud / n_lines AS ratio, ({KEYWORD_SQL}) / words AS density, coalesce(crit, 0) AS crit, coalesce(high, 0) AS high, n FROM t LEFT JOIN c USING (url))
SELECT url AS file_url, round(least(CASE WHEN ratio > 0.3 THEN 3.0 WHEN ratio > 0.1 THEN 1.5 ELSE 0 END + crit * 1.5 + high * 0.8 + CASE WHEN density > 0.05 THEN 2.0 WHEN density > 0.02 THEN 0.8 ELSE 0 END
  + CASE WHEN regexp_matches(url, '(\\.env|\\.pem|\\.key)$') AND n < 2000 THEN 1.0 ELSE 0 END, 10.0)::DOUBLE, 2) AS anomaly_score FROM x""")
def anomaly_score(spark, sf_dir):
    return score.anomaly(contents(spark, sf_dir), findings(spark, sf_dir)).select("file_url", "anomaly_score")


# Listings


@query(r"""WITH h AS (SELECT page_id, url AS base, list_distinct(list_transform(regexp_extract_all(html, '(?i)<a[^>]+href=["''][^"''?#][^"'']*["'']'), lambda x: trim(regexp_extract(x, '(?i)href=["'']([^"''?#][^"'']*)["'']', 1)))) AS links FROM pages)
SELECT page_id, regexp_extract(base, '^(https?://[^/]*)', 1) || href AS url, ltrim(href, '/') AS key, ends_with(href, '/') AS is_directory FROM (SELECT page_id, base, unnest(links) AS href FROM h) WHERE starts_with(href, '/')""")
def html_links(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("base_url"), "html")
    return listings.links(pages).select("page_id", "url", "key", "is_directory")


S3_BODY = '<ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/"><Name>b1</Name><IsTruncated>true</IsTruncated><NextContinuationToken>tok</NextContinuationToken><Contents><Key>app/.env</Key><Size>120</Size><LastModified>2024-01-01T00:00:00Z</LastModified><ETag>"abc"</ETag></Contents><Contents><Key>app/</Key><Size>0</Size></Contents><Contents><Key>x.js</Key><Size>n/a</Size></Contents><CommonPrefixes><Prefix>logs/</Prefix></CommonPrefixes></ListBucketResult>'
AZURE_BODY = '<EnumerationResults ServiceEndpoint="https://acct.blob.core.windows.net/cont/"><Blobs><Blob><Name>k.sql</Name><Properties><Content-Length>5</Content-Length><Last-Modified>x</Last-Modified></Properties></Blob></Blobs><NextMarker>m2</NextMarker></EnumerationResults>'


@query(f"SELECT url, key, size_bytes::BIGINT AS size_bytes, etag, file_type FROM {_values([('https://b/app/.env', 'app/.env', 120, 'abc', 'Environment'), ('https://b/x.js', 'x.js', 0, '', 'JavaScript')], 'url, key, size_bytes, etag, file_type')}")
def s3_listing(spark, sf_dir):
    rows = spark.createDataFrame([("https://b/", S3_BODY), ("https://c/", "<ListBucketResult><Contents><Key>broken")], "base_url string, body string")
    return listings.s3_files(rows).select("url", "key", "size_bytes", "etag", "file_type")


@query("SELECT true AS truncated, 'tok' AS token, 'logs/' AS prefixes")
def s3_page(spark, sf_dir):
    rows = spark.createDataFrame([("https://b/", S3_BODY)], "base_url string, body string")
    return listings.s3_pages(rows).select("truncated", "token", F.array_join("prefixes", ",").alias("prefixes"))


@query(f"SELECT url, size_bytes::BIGINT AS size_bytes, file_type, container_name, token FROM {_values([('https://a/cont/k.sql', 5, 'SQL / Database Dump', 'cont', 'm2')], 'url, size_bytes, file_type, container_name, token')}")
def azure_listing(spark, sf_dir):
    rows = spark.createDataFrame([("https://a/cont", AZURE_BODY)], "base_url string, body string")
    return listings.azure_files(rows).join(listings.azure_pages(rows), "base_url").select("url", "size_bytes", "file_type", "container_name", "token")


EDGES = [("r", "a"), ("r", "b"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("x", "y")]


@query(f"WITH RECURSIVE e AS (SELECT * FROM {_values(EDGES, 'src, dst')}), w AS (SELECT 'r' AS url, 0 AS depth UNION SELECT dst, depth + 1 FROM w JOIN e ON url = src WHERE depth < 3) SELECT url, min(depth)::BIGINT AS depth FROM w GROUP BY 1")
def crawl_depth(spark, sf_dir):
    edges, roots = spark.createDataFrame(EDGES, "src string, dst string"), spark.createDataFrame([("r",)], "url string")
    return listings.crawl(edges, roots, 3).select("url", F.col("depth").cast("long").alias("depth"))


def _zipped(member: str, text: str | None) -> bytes:
    """An archive with one text, and a member whose path leads out of it."""
    import io
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(member, text or "")
        z.writestr("../up.txt", "no")
    return held.getvalue()


NAME_SQL = "regexp_extract(key, '([^/]*)$', 1)"


@query(f"WITH {FILES_SQL} SELECT 'https://h/' || key || '.zip!/in/' || {NAME_SQL} || '.txt' AS file_url, 'Other' AS file_type, 'in/' || {NAME_SQL} || '.txt' AS archive_path, sha256(coalesce(content, '')) AS sha256 FROM files")
def archive_members(spark, sf_dir):
    """The documents of each source, zipped and unpacked again: every member comes back."""

    def run(frames):
        for frame in frames:
            content = [_zipped(f"in/{key.rpartition('/')[2]}.txt", text) for key, text in zip(frame["key"], frame["content"], strict=True)]
            yield frame[["key"]].assign(content=content).rename(columns={"key": "file_url"}).assign(file_url=[f"https://h/{key}.zip" for key in frame["key"]])

    objects = files(spark, sf_dir).select("key", "content").mapInPandas(run, "file_url string, content binary")
    return archives.texts(archives.unpacked(objects)).select("file_url", "file_type", "archive_path", F.sha2("content", 256).alias("sha256"))


def _packed_objects() -> list[tuple[str, bytes]]:
    """Archives of each kind; a path that leads out, a binary member and one that is no archive."""
    import bz2
    import gzip
    import io
    import tarfile

    held = io.BytesIO()
    with tarfile.open(fileobj=held, mode="w:gz") as t:
        for name, data in (("app/.env", b"K=1"), ("./run.sh", b"echo \xff"), ("/etc/x.txt", b"no"), ("n.py", b"\0" * 40)):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return [("https://h/a.tar.gz", held.getvalue()), ("https://h/d/dump.sql.gz", gzip.compress(b"select 1")), ("https://h/b.bz2", bz2.compress(b"z")), ("https://h/c.zip", _zipped("in.json", "{}")), ("https://h/e.zip", b"no zip"), ("https://h/f.7z", b"7z")]


UNPACKED = [("https://h/a.tar.gz!/app/.env", "Environment", "K=1"), ("https://h/a.tar.gz!/run.sh", "Shell Script", "echo �"), ("https://h/d/dump.sql.gz!/dump.sql", "SQL / Database Dump", "select 1"), ("https://h/b.bz2!/b", "Other", "z"), ("https://h/c.zip!/in.json", "JSON", "{}")]


@query(f"SELECT * FROM {_values(UNPACKED, 'file_url, file_type, content')}")
def archive_formats(spark, sf_dir):
    objects = spark.createDataFrame(_packed_objects(), "file_url string, content binary")
    return archives.texts(archives.unpacked(objects)).select("file_url", "file_type", "content")


@query("SELECT * FROM (VALUES ('https://h/e.zip'), ('https://h/f.7z')) AS t(file_url)")
def archive_errors(spark, sf_dir):
    return archives.unreadable(spark.createDataFrame(_packed_objects(), "file_url string, content binary")).select("file_url")


def _tiff(maker: bytes) -> bytes:
    """A TIFF block with the maker of a camera alone."""
    import struct

    return struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<HHHIII", 1, 0x010F, 2, len(maker) + 1, 26, 0) + maker + b"\0"


@query("SELECT 'https://h/a.tiff' AS file_url, 'IMAGE_DEVICE_INFO' AS rule_name, 'Make=Maker 1' AS match")
def exif_tags(spark, sf_dir):
    from quaymark.sources import images

    rows = spark.createDataFrame([("https://h/a.tiff", _tiff(b"Maker 1")), ("https://h/b.tiff", b"II*"), ("https://h/c.png", b"")], "file_url string, content binary")
    return exif.findings(images.read(rows)).select("file_url", "rule_name", "match")


LISTED = [("https://b/", S3_BODY, "AWS S3"), ("https://a/cont", AZURE_BODY, "Azure Blob Storage"), ("https://h/i/", '<a href="k.env">k</a><a href="sub/">s</a><a href="https://o/x">o</a>', "Open Directory Listing"), ("https://n/", "", "Unknown")]


@query("SELECT * FROM (VALUES ('https://b/', 'https://b/app/.env', 'Environment'), ('https://b/', 'https://b/x.js', 'JavaScript'), ('https://a/cont', 'https://a/cont/k.sql', 'SQL / Database Dump'), ('https://h/i/', 'https://h/i/k.env', 'Environment')) AS t(base_url, url, file_type)")
def listings_by_kind(spark, sf_dir):
    rows = spark.createDataFrame(LISTED, "base_url string, body string, container_type string")
    return listings.listed(rows).select("base_url", "url", "file_type")


SITE = {"https://h/": '<a href="a.txt">a</a><a href="s/">s</a><a href="gone/">g</a>', "https://h/s/": '<a href="b.env">b</a><a href="/">root</a><a href="t/">t</a>', "https://h/s/t/": '<a href="c.py">c</a>'}


def _page(url: str) -> str:
    if url not in SITE:
        raise OSError("404")
    return SITE[url]


@query("SELECT url, depth::BIGINT AS depth FROM (VALUES ('https://h/a.txt', 0), ('https://h/s/b.env', 1), ('https://h/s/t/c.py', 2)) AS t(url, depth)")
def crawl_fetched(spark, sf_dir):
    """A crawl that fetches its pages, here from a table."""
    return listings.crawl_pages(spark.createDataFrame([("https://h/",)], "url string"), _page).select("url", F.col("depth").cast("long").alias("depth"))


# Whole scans


@query(f"""WITH {FINDINGS_SQL}, found AS (
  SELECT f.ordinal, f.url, f.container_id, line_number, rule, nth, rule_name, severity, match, false AS from_archive FROM findings f JOIN files USING (url) WHERE file_type NOT IN ('Archive', 'Image')
  UNION ALL SELECT r.ordinal, r.url || '!/in.txt', r.container_id, line_number, rule, nth, rule_name, severity, match, true FROM ruled r JOIN files USING (url) WHERE file_type = 'Archive'
)
SELECT url AS file_url, rule_name, severity, match, from_archive FROM found
UNION ALL SELECT file_url, rule_name, 'Critical', '[redacted — duplicated across ' || n || ' files]', false FROM (SELECT arg_min(url, (ordinal, line_number, rule, nth)) AS file_url, 'DUPLICATE_SECRET:' || arg_min(rule_name, (ordinal, line_number, rule, nth)) AS rule_name, count(DISTINCT url) AS n FROM found GROUP BY substr(sha256(match), 1, 16) HAVING count(*) >= 2)
UNION ALL SELECT min(url), 'CREDENTIAL_REUSE:' || rule_name, 'High', '[' || count(DISTINCT url) || ' files affected]', false FROM found GROUP BY found.rule_name HAVING count(DISTINCT url) >= 3
UNION ALL SELECT DISTINCT container_id, 'PUBLIC_BUCKET_ACCESS', 'Critical', '[AWS S3]', false FROM files
UNION ALL SELECT container_id, rule_name, severity, '[AWS S3]', false FROM files JOIN {PATTERNS_SQL} ON regexp_matches(lower(key), pattern) GROUP BY container_id, i, rule_name, severity""")
def whole_scan(spark, sf_dir):
    """All that a scan finds: the documents are texts, members of archives, or images without tags, by their suffix."""
    from quaymark.plans import scan

    def run(frames):
        for frame in frames:
            content = [_zipped("in.txt", text) if kind == "Archive" else (text or "").encode() for kind, text in zip(frame["file_type"], frame["content"], strict=True)]
            yield frame[["file_url"]].assign(content=content)

    listed = files(spark, sf_dir)
    objects = contents(spark, sf_dir).select("file_url", "file_type", "content").mapInPandas(run, "file_url string, content binary")
    result = scan.scan(scan.Config("https://documents.example/", min_entropy=THRESHOLD), containers(spark, sf_dir), listed.drop("content"), objects)
    return result.findings.select("file_url", "rule_name", "severity", "match", "from_archive")


@query(f"WITH {FINDINGS_SQL} SELECT ordinal, line_number::BIGINT AS line_number, rule_name, severity, match FROM ruled")
def stream_findings(spark, sf_dir):
    """The documents as a stream, read to its end; what the rules find is a table then."""
    import uuid

    from quaymark.sources.kept import shared_folder
    from quaymark.streaming import scan as streaming

    kind = _table(spark, sf_dir, "documents").schema
    arriving = _contents(_files(spark.readStream.schema(kind).parquet(f"{sf_dir}/documents.parquet*")))
    at = f"{shared_folder(spark)}/quaymark-stream-{uuid.uuid4().hex}"
    found = streaming.rule_findings(arriving).select(F.col("seq.file").alias("ordinal"), F.col("line_number").cast("long").alias("line_number"), "rule_name", "severity", "match")
    found.writeStream.format("parquet").option("path", f"{at}/found").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{at}/found")


# Semantic analysis


@query(r"SELECT doc_id, left(regexp_replace(regexp_replace(text, '\b([A-Za-z0-9+/]{8})[A-Za-z0-9+/]{32,}={0,2}\b', '\1***', 'g'), '(-----BEGIN[^-]+-----)[^-]+(-----END[^-]+-----)', '\1 [REDACTED] \2', 'g'), 5000) AS sanitised FROM documents")
def ai_sanitise(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", scalars.sanitised(F.col("text")).alias("sanitised"))


FENCE = "`" * 3
REPLIES = [("u/1", '{"findings":[{"type":"api key","severity":"HIGH","confidence":1.0,"line_hint":"k=…"}]}'), ("u/2", FENCE + 'json\n{"findings":[{"severity":"odd"}]}\n' + FENCE), ("u/3", "no json"), ("u/4", '{"findings":[]}')]


@query("SELECT * FROM " + _values([("u/1", "AI_API_KEY", "High", 0.9, "k=…", "AI:p/m"), ("u/2", "AI_DETECTION", "Medium", 0.54, "[AI detected — no explicit match]", "AI:p/m")], "file_url, rule_name, severity, confidence, match, scanner"))
def ai_parse(spark, sf_dir):
    rows = spark.createDataFrame([(u, "Other", t, "p", "m") for u, t in REPLIES], "file_url string, file_type string, reply string, ai_provider string, ai_model string")
    return ai.parsed(rows).select("file_url", "rule_name", "severity", F.round("confidence", 2).alias("confidence"), "match", "scanner")


SQL["ai_parse"] = SQL["ai_parse"].replace("SELECT * FROM", "SELECT file_url, rule_name, severity, confidence::DOUBLE AS confidence, match, scanner FROM")


@query(f"WITH {FILES_SQL} SELECT ordinal, file_type IN ('Certificate / Key', 'Environment') OR regexp_matches(url, {_quoted(tables.HIGH_VALUE)}) AS high_value FROM files")
def high_value_files(spark, sf_dir):
    return files(spark, sf_dir).select("ordinal", ai.high_value(F.col("url"), F.col("file_type")).alias("high_value"))


@query(f"WITH {FINDINGS_SQL} SELECT ordinal FROM files WHERE file_type IN ('Certificate / Key', 'Environment') OR (regexp_matches(url, {_quoted(tables.HIGH_VALUE)}) AND url IN (SELECT url FROM findings))")
def ai_gate(spark, sf_dir):
    return ai.worth_asking(contents(spark, sf_dir), findings(spark, sf_dir)).select("ordinal")


ASKED = [("h/.env", "Environment", "K=1", True), ("h/b/.env", "Environment", " \n\t", False), ("h/x.pem", "Certificate / Key", "", False), ("h/config.json", "JSON", "mail a@example.org", True), ("h/config.json?1", "JSON", "{}", False), ("h/notes.txt", "Other", "mail a@example.org", False)]


@query(f"SELECT ordinal::BIGINT AS ordinal FROM {_values([(i, a[3]) for i, a in enumerate(ASKED)], 'ordinal, asked')} WHERE asked")
def ai_gate_inline(spark, sf_dir):
    rows = spark.createDataFrame([(i, f"https://{u}", t, x, "c") for i, (u, t, x, _) in enumerate(ASKED)], "ordinal long, file_url string, file_type string, content string, container_id string")
    return ai.worth_asking(rows, detect.scan(rows, THRESHOLD, context=False)).select("ordinal")


TAGS = [("https://h/a.jpg", {"Make": "Cam", "Artist": "Eve", "Software": ""}, True), ("https://h/b.jpg", {"Model": "M" * 50}, False), ("https://h/c.jpg", {}, False)]


@query("SELECT * FROM " + _values([("https://h/a.jpg", "IMAGE_GPS_COORDINATES", "Medium", "48.85833, -2.29444"), ("https://h/a.jpg", "IMAGE_DEVICE_INFO", "Low", "Make=Cam"), ("https://h/a.jpg", "IMAGE_AUTHOR_INFO", "Low", "Artist=***"), ("https://h/b.jpg", "IMAGE_DEVICE_INFO", "Low", "Model=" + "M" * 40)], "file_url, rule_name, severity, match"))
def exif_findings(spark, sf_dir):
    place = ((48.0, 51.0, 30.0, "N"), (2.0, 17.0, 40.0, "W"))
    rows = spark.createDataFrame([(u, t, place if g else None) for u, t, g in TAGS], exif.TAGS)
    return exif.findings(rows).select("file_url", "rule_name", "severity", "match")


# Reports


TITLE_SQL = f"regexp_extract(url, '([^/]*)$', 1)"


def _escaped_sql(x: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = f"replace({x}, {_quoted(raw)}, '{safe}')"
    return x


@query(f"""WITH {FINDINGS_SQL} SELECT ordinal, rule_name, '#### `' || {TITLE_SQL} || '` — ' || rule_name || chr(10) || chr(10) || '- **Category:** ' || category || chr(10) || '- **Description:** ' || description || chr(10) || '- **Confidence:** ' || printf('%.0f', confidence * 100) || '%  |  **Line:** ' || line_number
  || chr(10) || '- **Compliance:** ' || CASE WHEN len(refs) > 0 THEN array_to_string(refs, ', ') ELSE 'N/A' END || chr(10) || '- **Remediation:** ' || recommendation || chr(10) AS block FROM findings""")
def report_markdown_lines(spark, sf_dir):
    return report.markdown_lines(findings(spark, sf_dir)).select(F.col("seq.file").alias("ordinal"), "rule_name", "block")


@query(f"""WITH {_inline_sql(FINDINGS_SQL)} SELECT ordinal, rule_name, '<div class="f"><h4>' || {_escaped_sql(TITLE_SQL)} || ' — ' || {_escaped_sql('rule_name')} || '</h4><p>' || {_escaped_sql('description')} || '</p><pre></pre></div>' AS block FROM findings""")
def report_html_lines(spark, sf_dir):
    return report.html_lines(_inline_findings(spark)).select(F.col("seq.file").alias("ordinal"), "rule_name", "block")


JSON_SQL = ", ".join(
    f"'{name}', {value}"
    for name, value in (
        ("file_url", "f.url"), ("file_name", "regexp_extract(f.url, '([^/]*)$', 1)"), ("file_type", "file_type"), ("category", "category"), ("rule_name", "rule_name"), ("description", "description"), ("severity", "severity"), ("match", "match"), ("context", "''"),
        ("line_number", "line_number"), ("recommendation", "recommendation"), ("compliance_refs", "refs"), ("confidence", "confidence"), ("scanner", "scanner"), ("from_archive", "false"), ("archive_path", "''"),
    )
)


@query(f"WITH {FINDINGS_SQL} SELECT f.ordinal, json_object({JSON_SQL})::VARCHAR AS json FROM findings f JOIN files USING (url)")
def report_json(spark, sf_dir):
    return report.json_report(findings(spark, sf_dir)).select(F.col("seq.file").alias("ordinal"), "json")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """The batch form of the streaming counts."""
    rows = _table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n")
