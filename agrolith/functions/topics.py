"""Keyword rule that gives a note its topic; first matching rule wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword rules in the order they are tried, then the default topic.
TOPIC_RULES = [
    ("rain", ["rain", "precip"]),
    ("temperature", ["temp", "heat"]),
    ("model", ["hybrid", "fusion", "model"]),
    ("yield", ["yield", "improve", "potential"]),
]
DEFAULT_TOPIC = "general"


def insight_topic(text) -> Column:
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    out = None
    for topic, words in TOPIC_RULES:
        cond = None
        for w in words:
            c = low.contains(w)
            cond = c if cond is None else (cond | c)
        out = F.when(cond, F.lit(topic)) if out is None else out.when(cond, F.lit(topic))
    return out.otherwise(F.lit(DEFAULT_TOPIC))


def insight_topic_sql(text_sql: str) -> str:
    """DuckDB twin of :func:`insight_topic`."""
    parts = []
    for topic, words in TOPIC_RULES:
        cond = " OR ".join(f"contains(lower({text_sql}), '{w}')" for w in words)
        parts.append(f"WHEN {cond} THEN '{topic}'")
    return "CASE " + " ".join(parts) + f" ELSE '{DEFAULT_TOPIC}' END"
