"""Sinks: entity sets as JSON (S6) and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Output names of the saved entity sets.
KNOWLEDGE_JSON = "canonical_perspectives.json"
FEEDBACK_JSON = "user_feedback_corpus.json"
STATS_JSON = "processing_stats.json"


def save_entities(entities: DataFrame, out_dir: str, name: str, *, parquet: bool = True) -> str:
    """Write an entity set as JSON (UTF-8, not ASCII-escaped; VARIANT
    metadata written as plain nested JSON), plus Parquet for re-reading.

    The JSON output is a folder of part files (one JSON object per line):
    written in parallel, never gathered on one machine.
    """
    path = f"{out_dir.rstrip('/')}/{name}"
    entities.write.mode("overwrite").json(path)
    if parquet:
        entities.write.mode("overwrite").parquet(path.rsplit(".", 1)[0] + ".parquet")
    return path


def save_run_stats(summary: DataFrame, out_dir: str, *, settings: dict,
                   saved_files: list[str]) -> str:
    """One JSON object: timestamp, processing_stats, settings, saved_files."""
    path = f"{out_dir.rstrip('/')}/{STATS_JSON}"
    settings_col = F.struct(*[F.lit(v).alias(k) for k, v in settings.items()])
    row = summary.select(
        (F.unix_micros(F.current_timestamp()) / 1e6).alias("timestamp"),
        F.struct(*summary.columns).alias("processing_stats"),
        settings_col.alias("settings"),
        F.array(*[F.lit(s) for s in saved_files]).alias("saved_files"))
    row.coalesce(1).write.mode("overwrite").json(path)   # a single row
    return path
