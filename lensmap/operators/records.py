"""Record building and the feedback mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vector as V
from . import knn

MAPPED_COL = "mapped_perspectives"
MAPPING_K = 5                     # fixed value: the mapping always asks for 5


def perspective_type() -> T.ArrayType:
    return T.ArrayType(T.StructType([
        T.StructField("id", T.StringType(), True),
        T.StructField("score", T.DoubleType(), True),
        T.StructField("insight", T.StringType(), True),
        T.StructField("aspect", T.StringType(), True),
    ]), containsNull=False)


def knowledge_for_mapping(knowledge: DataFrame) -> DataFrame:
    """(id, vector, insight, aspect) from typed columns or a VARIANT metadata.

    ``insight``/``aspect`` are read like ``metadata.get(key, "")`` (T14).
    """
    cols = set(knowledge.columns)
    def field(name: str) -> Column:
        if name in cols:
            return F.col(name).cast("string")
        if "metadata" in cols:
            return F.coalesce(F.try_variant_get("metadata", f"$.{name}", "string"), F.lit(""))
        return F.lit("")
    return knowledge.select(F.col("id").cast("string").alias("id"), "vector",
                            field("insight").alias("insight"), field("aspect").alias("aspect"))


def map_feedback(feedback: DataFrame, knowledge: DataFrame | None, *,
                 vector_col: str = "vector", metric: str = V.COSINE,
                 output_col: str = MAPPED_COL, k: int = MAPPING_K,
                 broadcast_bytes: int | None = None, dim: int | None = None) -> DataFrame:
    """R3 (flagship): attach the top-5 knowledge entries to every feedback row.

    ``mapped_perspectives`` is ``array<struct<id, score, insight, aspect>>`` in
    score order.  A missing knowledge collection (None) or no hits gives an
    empty array and the row is kept (V9).  Knowledge within the broadcast
    budget is searched inside a select, so the feedback side is neither
    shuffled nor joined.  ``dim``: the collection's (or embedder's) dimension.
    """
    ptype = perspective_type()
    if knowledge is None:
        return feedback.withColumn(output_col, F.array().cast(ptype))
    kn = knowledge_for_mapping(knowledge)
    out = knn.knn_arrays(feedback, kn, output_col="_hits", k=k, metric=metric,
                         query_vector=vector_col, payload=["insight", "aspect"],
                         broadcast_bytes=broadcast_bytes, dim=dim)
    mapped = F.transform(F.coalesce(F.col("_hits"), F.array()), lambda h: F.struct(
        h["id"].alias("id"), h["score"].alias("score"),
        h["insight"].alias("insight"), h["aspect"].alias("aspect")))
    return out.withColumn(output_col, mapped.cast(ptype)).drop("_hits")


# ---------------------------------------------------------------------------
# Entities from scanned records
# ---------------------------------------------------------------------------

ENTITY_COLUMNS = ["id", "vector", "text_for_embedding", "metadata"]
# Keys of the metadata object.
KNOWLEDGE_OPTIONAL_KEYS = ["description", "examples", "keywords", "confidence", "source"]
FEEDBACK_RESERVED_KEYS = ["raw_text", "summary"]
DEFAULT_STATUS = "active"


def _raw(key: str) -> Column:
    return F.try_variant_get(F.col("item"), f"$.{key}", "variant")


def _str(key: str) -> Column:
    return F.try_variant_get(F.col("item"), f"$.{key}", "string")


def _present(key: str) -> Column:
    return _raw(key).isNotNull()


def _v(x) -> Column:
    """Any scalar column as VARIANT."""
    return (x if isinstance(x, Column) else F.lit(x)).cast("variant")


def _now() -> Column:
    return F.unix_micros(F.current_timestamp()) / F.lit(1e6)


def default_id(id_key: str, prefix: str) -> Column:
    """``str(item[id_key])`` if set, else ``<prefix>_<position>``.

    An explicit null id is treated like a missing one (the reference would
    produce the string 'None').
    """
    return F.coalesce(_str(id_key), F.concat(F.lit(prefix + "_"), F.col("gpos").cast("string")))


def knowledge_texts(records: DataFrame) -> DataFrame:
    """T2/T3 over scanned knowledge records: adds ``id`` and ``text_for_embedding``."""
    from ..functions import text as TX
    with_id = records.select("*", default_id("insight_id", "knowledge").alias("id"))
    return TX.with_knowledge_text(
        with_id, _str("aspect"), _str("insight"), _str("sentiment"), _str("description"),
        F.try_variant_get("item", "$.examples", "array<string>"),
        F.try_variant_get("item", "$.keywords", "array<string>"),
        insight_present=_present("insight"), aspect_present=_present("aspect"),
        insight_raw=_str("insight"), aspect_raw=_str("aspect"))


def knowledge_metadata(model: str) -> Column:
    """Fixed keys + the optional keys that are present (null included)."""
    fixed = F.create_map(
        F.lit("type"), _v("knowledge"),
        F.lit("aspect"), F.coalesce(_raw("aspect"), _v("")),
        F.lit("insight"), F.coalesce(_raw("insight"), _v("")),
        F.lit("sentiment"), F.coalesce(_raw("sentiment"), _v("")),
        F.lit("status"), F.coalesce(_raw("status"), _v(DEFAULT_STATUS)),
        F.lit("created_time"), _v(_now()),
        F.lit("model"), _v(model),
        F.lit("text_length"), _v(F.char_length("text_for_embedding").cast("long")),
        F.lit("embedding_dim"), _v(F.size("vector").cast("long")))
    optional = F.map_filter(
        F.create_map(*[x for k in KNOWLEDGE_OPTIONAL_KEYS for x in (F.lit(k), _raw(k))]),
        lambda k, v: v.isNotNull())
    return F.to_variant_object(F.map_concat(fixed, optional))


def feedback_texts(records: DataFrame, id_prefix: str = "feedback") -> DataFrame:
    """T4 over scanned feedback records: adds ``id`` and ``text_for_embedding``."""
    from ..functions import text as TX
    with_id = records.select("*", default_id("fb_id", id_prefix).alias("id"))
    return TX.with_feedback_text(with_id, _str("raw_text"), _str("summary"))


def feedback_metadata(model: str, mapped_col: str = MAPPED_COL) -> Column:
    """Fixed keys, then every input key not starting with '_' (other than
    raw_text/summary), which overrides a fixed key of the same name."""
    fixed = F.create_map(
        F.lit("type"), _v("feedback"),
        F.lit("raw_text"), F.coalesce(_raw("raw_text"), _v("")),
        F.lit("summary"), F.coalesce(_raw("summary"), F.parse_json(F.lit("null"))),
        F.lit("mapped_perspectives"), F.to_variant_object(F.col(mapped_col)),
        F.lit("created_time"), _v(_now()),
        F.lit("model"), _v(model),
        F.lit("text_length"), _v(F.char_length("text_for_embedding").cast("long")),
        F.lit("embedding_dim"), _v(F.size("vector").cast("long")),
        F.lit("match_count"), _v(F.size(mapped_col).cast("long")))
    reserved = F.array(*[F.lit(k) for k in FEEDBACK_RESERVED_KEYS])
    passthrough = F.map_filter(
        F.coalesce(F.try_variant_get("item", "$", "map<string,variant>"),
                   F.create_map().cast("map<string,variant>")),
        lambda k, v: ~F.array_contains(reserved, k) & ~k.startswith("_"))
    keep_fixed = F.map_filter(fixed, lambda k, v: ~F.array_contains(F.map_keys(passthrough), k))
    return F.to_variant_object(F.map_concat(keep_fixed, passthrough))


def build_knowledge(records: DataFrame, embedder, *, cache=None):
    """Texts -> embeddings (failed dropped, E6) -> metadata -> entities.

    Returns the embed result with ``entities`` attached.
    """
    from .embedding import embed_records
    texts = knowledge_texts(records)
    res = embed_records(texts, "text_for_embedding", embedder, cache=cache, out_col="vector")
    ent = res.embedded.select("id", "vector", "text_for_embedding",
                              knowledge_metadata(embedder.model).alias("metadata"), "gpos")
    res.entities = ent
    return res


def build_feedback(records: DataFrame, embedder, knowledge: DataFrame | None, *,
                   cache=None, metric: str = V.COSINE, broadcast_bytes: int | None = None,
                   id_prefix: str = "feedback"):
    """R2: texts -> embeddings -> drop failed -> R3 mapping -> metadata -> entities."""
    from .embedding import embed_records
    texts = feedback_texts(records, id_prefix)
    res = embed_records(texts, "text_for_embedding", embedder, cache=cache, out_col="vector")
    mapped = map_feedback(res.embedded, knowledge, metric=metric,
                          broadcast_bytes=broadcast_bytes, dim=embedder.dim)
    ent = mapped.select("id", "vector", "text_for_embedding",
                        feedback_metadata(embedder.model).alias("metadata"), "gpos")
    res.entities = ent
    return res


class UnknownRecordType(ValueError):
    pass


def build_dictionary(data_type: str, records: DataFrame, embedder, *,
                     knowledge: DataFrame | None = None, cache=None, **kw):
    """Dispatch on the record type - 'knowledge' (R1) or 'feedback' (R2).

    Any other type raises; an empty input simply yields empty results.
    """
    if data_type == "knowledge":
        return build_knowledge(records, embedder, cache=cache)
    if data_type == "feedback":
        return build_feedback(records, embedder, knowledge, cache=cache, **kw)
    raise UnknownRecordType(f"unknown data type: {data_type}")
