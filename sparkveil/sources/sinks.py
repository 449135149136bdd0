"""Sinks: deterministic JSON lines, the audit projection, small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.operators.domains import UNSUPPORTED

#: The event of a span in the gateway log.
SPAN_SANITIZED = "pipeline.span_sanitized"
#: The only fields an audit row may have; free texts never pass.
AUDIT_FIELDS = ("event", "correlation_id", "session_id", "timestamp_ms", "latency_ms", "tier", "entity_type", "span_length", "status", "error")


def jsonl_rows(df: DataFrame) -> DataFrame:
    """One ``value`` per row: a JSON object of all columns, keys sorted, nulls kept."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, order_by: list[str]) -> None:
    """Write JSON lines, the rows of all files together in order."""
    jsonl_rows(df.orderBy(*order_by)).write.mode("overwrite").text(path)


def audit_rows(df: DataFrame) -> DataFrame:
    """The allow-listed columns of ``df``, missing ones null; everything else is dropped."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in AUDIT_FIELDS])


def span_events(found: DataFrame) -> DataFrame:
    """A row for each span of (..., text, spans): what may be said of it; the text is dropped."""
    kept = [c for c in found.columns if c not in ("text", "spans")]
    span = found.select(*kept, F.explode_outer("spans").alias("s")).where("s is not null")
    return span.select(*kept, F.lit(SPAN_SANITIZED).alias("event"), "s.tier", "s.entity_type", (F.col("s.end") - F.col("s.start")).alias("span_length"),
                       F.when(F.col("s.entity_type").isin(*UNSUPPORTED), "refused").otherwise("ok").alias("status"))


def markdown_report(df: DataFrame, limit: int = 200) -> str:
    """A small result (``limit`` rows at most) as a Markdown table."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report has {limit} rows at most")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(df.columns), line(["-"] * len(df.columns)), *(line([str(v) for v in r]) for r in rows)]) + "\n"
