"""The whole batch run (entry point 1 of the reference's data flow).

knowledge dir --S1--> R1 --C4--> collection 'knowledge'
feedback dir  --S1--> R2 (R3 against the stored knowledge) --C4--> 'feedback'
both collections --S6--> JSON; cache --S9--> saved; A2/A4 --S7--> stats

Knowledge is stored before feedback is mapped and handed over explicitly,
so the mapping can never run against a half-written catalogue.  Options are
plain arguments (the reference's async mode silently ignored several).
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import stats as ST
from ..operators.embedding import EmbeddingCache, embed_stats
from ..operators.records import build_feedback, build_knowledge
from ..operators.store import CollectionStore
from ..session import materialize
from ..sources import json_dir, sinks

KNOWLEDGE = "knowledge"
FEEDBACK = "feedback"


@dataclass
class RunResult:
    knowledge: DataFrame
    feedback: DataFrame
    bad_files: DataFrame
    failed: DataFrame
    summary: DataFrame
    collections: DataFrame
    embed_stats: DataFrame      # E7/E8, one row per kind
    balance: DataFrame          # kind, scanned, failed, rejected, replaced, stored, lost
    saved_files: list[str] = field(default_factory=list)


def _balance(spark: SparkSession, kind: str, in_files: int, res, rejected: DataFrame,
             stored: DataFrame) -> DataFrame:
    """What became of every record of the input: scanned = failed + rejected +
    replaced (by a later record of the same id) + stored + lost.  ``in_files``
    is counted in the input files themselves, not in the scan's result."""
    ids = res.entities.select("id")
    bad = rejected.select("id")
    n = {"scanned": in_files, "failed": res.failed.count(), "rejected": bad.count()}
    accepted = ids.count() - n["rejected"]
    found = (ids.distinct().join(stored.select("id").distinct(), "id", "left_semi")).count()
    distinct = ids.join(bad, "id", "left_anti").distinct().count()
    lost = (n["scanned"] - n["failed"] - n["rejected"] - accepted) + max(0, distinct - found)
    return spark.createDataFrame(
        [(kind, n["scanned"], n["failed"], n["rejected"], accepted - distinct, min(found, distinct), lost)],
        "kind string, scanned long, failed long, rejected long, replaced long, stored long, lost long")


def run_mapping(spark: SparkSession, knowledge_dir: str, feedback_dir: str, *,
                store_root: str, out_dir: str, embedder, cache_path: str | None = None,
                metric: str = V.COSINE, force: bool = False, upsert: bool = True,
                json_lines: bool = False, strict: bool = False) -> RunResult:
    """Process both directories end to end and return what was written.

    ``strict``: files that Python's json would refuse are bad files (whole-file
    mode).  The cache is saved as soon as each embed stage is done, so a later
    failure loses no model call.  The run is a success only when every record
    is accounted for (``balance``).
    """
    t0 = time.time()
    if json_lines and strict:
        raise ValueError("strict applies to whole JSON files, not to JSON lines")

    def scan(directory):
        if json_lines:
            return json_dir.scan_json_lines(spark, directory)
        return json_dir.scan_json_dir(spark, directory, strict=strict)

    cache = EmbeddingCache(spark, cache_path, embedder.model) if cache_path else None
    store = CollectionStore(spark, store_root)
    write = store.upsert if upsert else store.append

    def keep(kind, res):
        """Entities written once (the store, the balance and the sinks read them), cache saved."""
        if cache is not None:
            cache.save(res.fresh)
        res.entities = materialize(res.entities, f"{kind}-entities")
        store.create(kind, dim=embedder.dim, metric=metric, force=force)
        return write(kind, res.entities)[1]

    k_rec, k_bad = scan(knowledge_dir)
    k_res = build_knowledge(k_rec, embedder, cache=cache)
    k_rej = keep(KNOWLEDGE, k_res)
    knowledge = store.read(KNOWLEDGE)

    f_rec, f_bad = scan(feedback_dir)
    f_res = build_feedback(f_rec, embedder, knowledge, cache=cache,
                           metric=store.manifest(KNOWLEDGE)["metric"])
    f_rej = keep(FEEDBACK, f_res)
    feedback = store.read(FEEDBACK)

    def in_files(directory, bad):
        return json_dir.count_records(spark, directory, json_lines, strict) - (bad.count() if json_lines else 0)

    balance = (_balance(spark, KNOWLEDGE, in_files(knowledge_dir, k_bad), k_res, k_rej, knowledge)
               .unionByName(_balance(spark, FEEDBACK, in_files(feedback_dir, f_bad), f_res, f_rej, feedback)))
    embed = None
    for kind, res in ((KNOWLEDGE, k_res), (FEEDBACK, f_res)):
        row = embed_stats(res.records, res.vectors, "vector").withColumn("kind", F.lit(kind))
        embed = row if embed is None else embed.unionByName(row)

    saved = [sinks.save_entities(knowledge, out_dir, sinks.KNOWLEDGE_JSON),
             sinks.save_entities(feedback, out_dir, sinks.FEEDBACK_JSON)]
    failed = (k_res.failed.select(F.lit(KNOWLEDGE).alias("kind"), "id", "reason")
              .unionByName(f_res.failed.select(F.lit(FEEDBACK).alias("kind"), "id", "reason"))
              .unionByName(k_rej.select(F.lit(KNOWLEDGE).alias("kind"), "id", "reason"))
              .unionByName(f_rej.select(F.lit(FEEDBACK).alias("kind"), "id", "reason")))
    bad = k_bad.unionByName(f_bad)
    lost = balance.filter("lost <> 0").select(F.concat(F.col("lost").cast("string"), F.lit(" records lost: "), "kind").alias("reason"))
    errors = failed.select("reason").unionByName(bad.select(F.col("error").alias("reason"))).unionByName(lost)
    # Counted after the work is done, then written.
    summary = ST.run_summary(knowledge, feedback, errors, time.time() - t0)
    collections = store.info([KNOWLEDGE, FEEDBACK])
    sinks.save_run_stats(summary, out_dir,
                         settings={"embedding_model": embedder.model,
                                   "vector_dim": embedder.dim,
                                   "similarity_metric": V.normalize_metric(metric)},
                         saved_files=[p.rsplit("/", 1)[1] for p in saved])
    return RunResult(knowledge, feedback, bad, failed, summary, collections, embed, balance, saved)
