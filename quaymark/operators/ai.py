"""Semantic analysis by a language model: which files, what it sees, and what becomes of its reply. The model is a plug-in."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark import schema
from quaymark.functions import scalars, tables

REPLY = "struct<findings:array<struct<type:string,severity:string,confidence:double,description:string,line_hint:string,recommendation:string>>>"


@dataclass(frozen=True)
class Reply:
    text: str
    provider: str
    model: str

    @property
    def ok(self) -> bool:
        return bool(self.text.strip())


class Provider(Protocol):
    """What a model has to offer. It is sent to executors, so it opens its connection when first asked."""

    def complete(self, prompt: str, max_tokens: int = 1500) -> Reply: ...


class AuthenticationError(Exception):
    """A provider's refusal of its credentials, which no other provider makes good."""


class Heuristic:
    """The provider without a model: it has nothing to say about a file."""

    def complete(self, prompt: str, max_tokens: int = 1500) -> Reply:
        return Reply("", "heuristic", "builtin")


class Chain:
    """Asks providers in turn; the first reply that is not blank counts. Refused credentials are an error at once."""

    def __init__(self, providers: Iterable[Provider] = ()):
        self.providers = [*providers, Heuristic()]

    def complete(self, prompt: str, max_tokens: int = 1500) -> Reply:
        reply = Reply("", "none", "none")
        for provider in self.providers:
            try:
                reply = provider.complete(prompt, max_tokens)
            except AuthenticationError:
                raise
            except Exception:  # noqa: BLE001, S112  a provider that fails is passed over, whatever its reason
                continue
            if reply.ok:
                break
        return reply


#: What a question may carry and its reply hold: characters or items, tokens.
SUMMARY_LIMITS, FILE_LIMITS, ANOMALY_LIMITS = (10_000, 1500), (4000, 800), ((10, 20), 200)


def summarised(provider: Provider, report_json: str) -> Reply:
    """An executive summary of a report."""
    most, tokens = SUMMARY_LIMITS
    return provider.complete(f"Write an executive summary of this storage audit for managers, with priorities, in Markdown.\n\n{report_json[:most]}", tokens)


def analysed(provider: Provider, file_name: str, file_type: str, content: str) -> Reply:
    """What a model sees in a file, as JSON that ``parsed`` reads."""
    most, tokens = FILE_LIMITS
    wanted = '{"findings": [{"type", "severity", "confidence", "description", "line_hint", "recommendation"}]}'
    return provider.complete(f"List secrets, personal data and misconfigurations in this file. Answer with JSON alone: {wanted}\n\nFile: {file_name} ({file_type})\n\n{content[:most]}", tokens)


def anomaly_rated(provider: Provider, file_name: str, tokens: list[str], rules: list[str]) -> tuple[float | None, str]:
    """(score from 0 to 10, explanation) of a file's findings; (None, "") if the reply is no such JSON."""
    (n_tokens, n_rules), most = ANOMALY_LIMITS
    asked_ = {"file": file_name, "high_entropy_strings": tokens[:n_tokens], "rules": rules[:n_rules]}
    reply = provider.complete(f'How anomalous is this file, from 0 to 10? Answer with JSON alone: {{"score", "explanation"}}\n\n{json.dumps(asked_)}', most)
    try:
        found = json.loads(reply.text)
        return min(10.0, max(0.0, float(found["score"]))), str(found.get("explanation", ""))
    except (ValueError, TypeError, KeyError, AttributeError):
        return None, ""


#: Makers of providers by name: (key, options) to a provider. Vendors' clients are registered by those who have them.
MAKERS: dict[str, Callable[[str | None, dict], Provider]] = {}


def chain_for(name: str | None, key: str | None = None, needs_key: bool = True, **options) -> Chain:
    """The providers to ask: the named one and the heuristic behind it; the heuristic alone without a name, or if the maker fails."""
    if not name:
        return Chain()
    maker = MAKERS.get(name.lower())
    if maker is None:
        raise ValueError(f"unknown provider {name!r}; there are: {', '.join(sorted(MAKERS)) or 'none'}")
    if needs_key and not key:
        raise AuthenticationError(f"{name} needs a key")
    try:
        return Chain([maker(key, options)])
    except AuthenticationError:
        raise
    except Exception:  # noqa: BLE001  whatever keeps a client from being made, analysis goes on without it
        return Chain()


def high_value(file_url: Column, file_type: Column) -> Column:
    return file_type.isin("Certificate / Key", "Environment") | file_url.rlike(tables.HIGH_VALUE)


def worth_asking(contents: DataFrame, findings: DataFrame) -> DataFrame:
    """Contents of high value that have findings, or are environment or key files, and are not blank."""
    flagged = findings.select("file_url").distinct().withColumn("flagged_", F.lit(True))
    good = contents.where(high_value(F.col("file_url"), F.col("file_type")) & F.col("content").rlike(r"\S"))
    joined = good.join(flagged, "file_url", "left")
    return joined.where(F.col("flagged_").isNotNull() | F.col("file_type").isin("Environment", "Certificate / Key")).drop("flagged_")


def asked(contents: DataFrame, provider: Provider) -> DataFrame:
    """contents with reply, ai_provider, ai_model; texts are sanitised before they leave."""
    prompts = contents.withColumn("prompt_", scalars.sanitised(F.col("content"), FILE_LIMITS[0])).drop("content")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.drop("prompt_").schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies = [analysed(provider, url, kind_, p) for url, kind_, p in zip(frame["file_url"], frame["file_type"], frame.pop("prompt_"), strict=True)]
            yield frame.assign(reply=[r.text for r in replies], ai_provider=[r.provider for r in replies], ai_model=[r.model for r in replies])

    return prompts.mapInPandas(run, f"{kind}, reply string, ai_provider string, ai_model string")


def parsed(replies: DataFrame) -> DataFrame:
    """Findings in the replies (file_url, file_type, reply, ai_provider, ai_model); what is no JSON gives none."""
    items = replies.withColumn("r_", F.from_json(scalars.unfenced(F.col("reply")), REPLY)).select("*", F.posexplode("r_.findings").alias("nth_", "f"))
    order = {s.lower(): s for s in tables.SEVERITIES}
    severity = tables.lookup(order, F.lower(F.coalesce("f.severity", F.lit("medium"))), "Medium")
    rule = F.concat(F.lit("AI_"), F.replace(F.upper(F.coalesce("f.type", F.lit("DETECTION"))), F.lit(" "), F.lit("_")))
    return schema.finding(
        items.drop("reply", "r_"), file_name=scalars.url_filename(F.col("file_url")), category=F.lit(tables.SECRET), rule_name=rule, description=F.concat(F.lit("[AI] "), F.coalesce("f.description", tables.text("ai"))), severity=severity,
        match=F.coalesce("f.line_hint", tables.text("ai_match")), recommendation=F.coalesce("f.recommendation", tables.text("ai_advice")),
        confidence=F.least(F.coalesce("f.confidence", F.lit(0.6)) * 0.9, F.lit(0.95)), scanner=F.concat(F.lit("AI:"), F.col("ai_provider"), F.lit("/"), F.col("ai_model")), seq=schema.sequence(F.lit(0), F.lit(0), F.lit(0), F.col("nth_")),
    )
