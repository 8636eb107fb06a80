"""Log levels: their order, and what other words for them mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The levels in ascending order, and the words that mean each.
LEVELS = ["trace", "debug", "info", "warn", "error", "fatal"]
WORDS = {
    "trace": ["trace"],
    "debug": ["debug"],
    "info": ["info", "notice"],
    "warn": ["warn", "warning"],
    "error": ["error", "err", "crit", "critical"],
    "fatal": ["fatal", "emerg", "emergency", "alert", "panic"],
}
#: Syslog severities 0 to 7.
SEVERITIES = ["fatal", "fatal", "error", "error", "warn", "info", "info", "debug"]


def level_of(word: str) -> str:
    """The level that a word means; info for any other word."""
    return next((level for level, words in WORDS.items() if word.lower() in words), "info")


def normalise(word: str | Column) -> Column:
    """level_of() for a column; null for null."""
    lower = F.lower(word)
    out = F.when(lower.isNull(), F.lit(None))
    for level, words in WORDS.items():
        if level != "info":
            out = out.when(lower.isin(words), F.lit(level))
    return out.otherwise("info")


def rank(level: str | Column) -> Column:
    """0 for trace up to 5 for fatal; null for any other text."""
    level = F.col(level) if isinstance(level, str) else level
    return F.when(level.isin(LEVELS), F.array_position(F.lit(LEVELS), level) - 1).cast("int")


def at_least(level: str | Column, least: str) -> Column:
    """Whether a level isn't below least: a list of values, which a scan can use."""
    level = F.col(level) if isinstance(level, str) else level
    return level.isin(LEVELS[LEVELS.index(level_of(least)) :])


def is_error(level: str | Column) -> Column:
    return at_least(level, "error")


def level_of_priority(priority: str | Column) -> Column:
    """The level of a syslog priority (facility * 8 + severity) given as text; info if it isn't 0 to 255."""
    number = F.expr("null").cast("int") if priority is None else (F.col(priority) if isinstance(priority, str) else priority).try_cast("int")
    return F.when(number.between(0, 255), F.element_at(F.lit(SEVERITIES), F.pmod(number, F.lit(8)) + 1)).otherwise("info")
