"""Column expressions shared by the operators."""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import AUTHORITY_COMPLEXITY, AUTHORITY_WEIGHT, CAPABILITY_WEIGHT, COST, EPOCH, EVENT_WORDS, OTHER_CAPABILITY_WEIGHT, QUALITY_WEIGHT

COMPARE: dict[str, Callable[[Column, Column], Column]] = {"<=": operator.le, "<": operator.lt, ">=": operator.ge, ">": operator.gt, "==": operator.eq}


def epoch() -> Column:
    return F.lit(EPOCH).cast("timestamp")


def lookup(values: dict[str, float | str], key: Column, default: float | str | None = None) -> Column:
    """The value of key in a small fixed table."""
    found = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def filled(col: Column | str, default: str = "UNKNOWN") -> Column:
    """The text, or the default where it is null or empty."""
    return F.coalesce(F.nullif(col if isinstance(col, Column) else F.col(col), F.lit("")), F.lit(default))


def event_type(text: Column) -> Column:
    """The event type that the text names, or null; an unknown word is never guessed at."""
    return lookup({word: kind for kind, words in EVENT_WORDS.items() for word in words}, F.lower(F.trim(text)))


def parsed_time(text: Column) -> Column:
    """ISO 8601 to a timestamp, without an offset as UTC (the session's zone); null, empty or bad text: null."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("timestamp")


def minutes(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(60_000_000.0)


def concern_score(quality: Column, authority: Column, capability: Column) -> Column:
    weight = lookup(CAPABILITY_WEIGHT, capability, OTHER_CAPABILITY_WEIGHT)
    return lookup(QUALITY_WEIGHT, quality) * weight * lookup(AUTHORITY_WEIGHT, authority)


def review_minutes(n_events: Column, quality: Column, authority: Column, n_alerts: int = 1, coefficients: dict[str, float] | None = None) -> Column:
    """Minutes that a review is expected to take; the complexity of the authority scales the whole sum."""
    c = COST | (coefficients or {})
    base = F.lit(c["base"] + c["per_alert"] * n_alerts) + c["per_event"] * n_events + F.when(quality != "HIGH", c["low_quality"]).otherwise(0.0)
    return base * lookup(AUTHORITY_COMPLEXITY, authority)


def finding_id(*parts: Column | str) -> Column:
    """A name that follows from what the finding is about, so verdicts keep to it when it is found again."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def label(text: Column) -> Column:
    """A code as words; null reads `Not recorded`."""
    words = F.lower(F.replace(text, F.lit("_"), F.lit(" ")))
    return F.coalesce(F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 20)), F.lit("Not recorded"))
