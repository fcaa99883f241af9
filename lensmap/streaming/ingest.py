"""Incremental feedback ingest with Structured Streaming (extension).

New JSON files in the feedback folder are picked up by the file source;
each micro-batch is parsed (S1/S2), built and mapped (R2 + R3) against the
static knowledge collection and upserted (C4) into the feedback collection.
Bad files go to a quarantine table.  The stream is stateless: no watermark
is needed.  A replayed batch (after a failure) writes the same ids again and
the upsert makes that a no-op, so output is exactly-once in effect.

Default ids of records without ``fb_id`` are ``feedback_b<batch>_<position>``:
positions restart in every batch, so the batch number keeps them unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import vector as V
from ..operators.embedding import EmbeddingCache
from ..operators.records import build_feedback
from ..operators.store import CollectionStore
from ..sources import json_dir

FEEDBACK = "feedback"


def feedback_stream(spark: SparkSession, feedback_dir: str, glob: str = "*.json",
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """One row per new file: (file, value)."""
    r = spark.readStream.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.text(feedback_dir, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), "value")


def ingest_feedback(spark: SparkSession, feedback_dir: str, *, store: CollectionStore,
                    knowledge: DataFrame | None, embedder, checkpoint_location: str,
                    quarantine_path: str | None = None, failed_path: str | None = None,
                    metric: str = V.COSINE, cache_path: str | None = None,
                    glob: str = "*.json", available_now: bool = True, processing_time: str | None = None,
                    max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the ingest; with ``available_now`` it stops when caught up.

    ``metric`` is the knowledge collection's (feedback is scored by it, as in
    the batch run).  Bad files go to ``quarantine_path``, records that could
    not be embedded or stored to ``failed_path``, each in a folder per batch
    that a replay overwrites.
    """
    metric = V.normalize_metric(metric)
    if not store.exists(FEEDBACK):
        store.create(FEEDBACK, dim=embedder.dim, metric=metric)
    cache = EmbeddingCache(spark, cache_path, embedder.model) if cache_path else None

    def process(batch: DataFrame, batch_id: int) -> None:
        files = batch.withColumn("doc", F.try_parse_json("value"))
        rec = json_dir.explode_records(files)
        res = build_feedback(rec, embedder, knowledge, metric=metric, cache=cache,
                             id_prefix=f"feedback_b{batch_id}")
        if cache is not None:
            cache.save(res.fresh)
        _, rejected = store.upsert(FEEDBACK, res.entities)
        if quarantine_path:
            json_dir.bad_files(files).write.mode("overwrite").parquet(f"{quarantine_path}/batch_id={batch_id}")
        if failed_path:
            (res.failed.select("id", "reason").unionByName(rejected.select("id", "reason"))
             .write.mode("overwrite").parquet(f"{failed_path}/batch_id={batch_id}"))

    w = (feedback_stream(spark, feedback_dir, glob, max_files_per_trigger).writeStream
         .foreachBatch(process).option("checkpointLocation", checkpoint_location))
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()
