"""Personal data, toxicity terms and injection patterns as column expressions."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns by entity type, in the order of redaction.
PERSONAL = {
    "EMAIL_ADDRESS": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "PHONE_NUMBER": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "CREDIT_CARD": r"\b(?:\d[ -]*?){13,16}\b",
    "IBAN": r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
    "IP_ADDRESS": r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
}
#: Terms that flag a text wherever they stand in it.
TOXIC = ["hate", "idiot", "stupid", "kill", "terrorist", "worthless", "moron", "dumb"]
#: Patterns of attempts to take over a prompt.
INJECTION = [r"ignore previous instructions", r"disregard.*system.*prompt", r"you are now", r"system prompt", r"developer message", r"<\|.*\|>", r"###.*instruction"]
JAILBREAK = [r"\bjailbreak\b", r"\bdo anything now\b", r"\bdan\b", r"\bunlock\b"]
#: What an answer must not contain, and what triggers its filter.
FILTER_TERMS = ["hate", "idiot", "stupid", "kill", "terrorist"]
FILTER_TRIGGERS = ["ignore previous instructions", "disregard previous instructions", "system prompt", "developer message", "act as", "jailbreak"]


def _t(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def counts(text: Column | str, types: list[str] | None = None) -> dict[str, Column]:
    return {k: F.when(_may(text, k), F.regexp_count(_t(text), F.lit(PERSONAL[k]))).otherwise(0).cast("long") for k in types or PERSONAL}


def redact(text: Column | str, types: list[str] | None = None) -> Column:
    """Each match replaced by its type in brackets, one type after another. Texts without @ and digits pass as they are."""
    out = reduce(lambda t, k: F.regexp_replace(t, PERSONAL[k], f"[{k}]"), types or PERSONAL, _t(text))
    return F.when(_t(text).rlike("[0-9@]"), out).otherwise(_t(text))


def found(text: Column | str, types: list[str] | None = None) -> Column:
    return F.filter(F.array(*[F.when(_may(text, k) & _t(text).rlike(PERSONAL[k]), k) for k in types or PERSONAL]), lambda x: x.isNotNull())


def _may(text: Column | str, kind: str) -> Column:
    """Whether text has what every match of a type has; cheaper than the pattern."""
    return F.contains(_t(text), F.lit("@")) if kind == "EMAIL_ADDRESS" else _t(text).rlike("[0-9]{2}" if kind != "IP_ADDRESS" else r"[0-9]\.[0-9]")


def any_of(text: Column | str, patterns: list[str]) -> Column:
    """Whether the lower-cased text has a match. A pattern is tried only where its longest plain part is, and not at all if it is plain."""
    return _any(F.lower(_t(text)), patterns)


def _any(lowered: Column, patterns: list[str]) -> Column:
    def one(p: str) -> Column:
        if not re.fullmatch(r"(?:[\w <#]|\\b|\.\*|\\\|)+", p):
            return lowered.rlike(p)
        plain = max(re.split(r"\\b|\.\*|\\\||[^\w <#]", p), key=len)
        there = F.contains(lowered, F.lit(plain))
        return there if plain == p else there & lowered.rlike(p)

    return reduce(Column.__or__, map(one, patterns))


def moderation(text: Column | str) -> Column:
    """struct(toxicity, flags)"""
    toxic, injection, jailbreak = (any_of(text, p) for p in (TOXIC, INJECTION, JAILBREAK))
    flags = F.array(F.when(toxic, "toxicity"), F.when(injection, "prompt_injection"), F.when(jailbreak, "jailbreak"))
    return F.struct(toxic.cast("double").alias("toxicity"), F.filter(flags, lambda x: x.isNotNull()).alias("flags"))


def spans(df, text: str = "text", types: list[str] | None = None):
    """df with entities: array of struct(entity_type, start, end, value), offsets in code points, by type and then place."""
    chosen = {k: re.compile(PERSONAL[k]) for k in types or PERSONAL}

    @F.pandas_udf("array<struct<entity_type:string,start:int,end:int,value:string>>")
    def find(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"entity_type": k, "start": m.start(), "end": m.end(), "value": m[0]} for k, p in chosen.items() for m in p.finditer(t or "")])

    return df.withColumn("entities", find(F.col(text)))
