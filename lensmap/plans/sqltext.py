"""SQL-text builders for the brute-force oracle queries (DuckDB dialect).

The oracle checks our Spark plans against a plain SQL statement of the same
semantics.  RE2 has no back-references, so the repeat collapse is six chained
replaces; the character classes are the same code-point lists Spark uses.
"""

from __future__ import annotations

from ..functions import text as TX


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def clean(expr: str) -> str:
    s = f"trim(regexp_replace(coalesce(CAST({expr} AS VARCHAR), ''), {q(TX.WS_RUN)}, ' ', 'g'))"
    s = f"regexp_replace({s}, {q(TX.DELETE_RE)}, '', 'g')"
    for ch in TX.REPEAT_PUNCT:
        pat = ("\\" + ch) if ch in ".?" else ch
        s = f"regexp_replace({s}, {q(pat + '+')}, {q(ch)}, 'g')"
    return f"trim({s})"


def labelled(label: str, value_sql: str) -> str:
    return f"CASE WHEN {value_sql} <> '' THEN {q(label)} || {value_sql} END"


def feedback_text(raw: str, summary: str) -> str:
    r, s = clean(raw), clean(summary)
    return (f"CASE WHEN {r} = '' THEN {q(TX.EMPTY_FEEDBACK)} "
            f"WHEN {s} <> '' THEN {q(TX.LABEL_SUMMARY)} || {s} || {q(TX.PART_SEPARATOR)} || "
            f"{q(TX.LABEL_ORIGINAL)} || {r} "
            f"ELSE {q(TX.LABEL_FEEDBACK)} || {r} END")


def knowledge_text(aspect: str, insight: str, sentiment: str, description: str,
                   examples: str, keywords: str) -> str:
    """T2/T3 over list columns; keys are always present in table-derived input."""
    ex = (f"list_filter(coalesce({examples}, []::VARCHAR[])[1:{TX.MAX_EXAMPLES}], "
          f"lambda e: e IS NOT NULL AND e <> '')")
    kw = f"list_filter(coalesce({keywords}, []::VARCHAR[]), lambda e: e IS NOT NULL AND e <> '')"
    ex_txt = f"array_to_string(list_transform({ex}, lambda e: {clean('e')}), {q(TX.EXAMPLE_SEPARATOR)})"
    kw_txt = f"array_to_string(list_transform({kw}, lambda e: {clean('e')}), {q(TX.KEYWORD_SEPARATOR)})"
    parts = ", ".join([
        labelled(TX.LABEL_ASPECT, clean(aspect)),
        labelled(TX.LABEL_INSIGHT, clean(insight)),
        labelled(TX.LABEL_SENTIMENT, clean(sentiment)),
        labelled(TX.LABEL_DESCRIPTION, clean(description)),
        f"CASE WHEN len({ex}) > 0 THEN {q(TX.LABEL_EXAMPLES)} || {ex_txt} END",
        f"CASE WHEN len({kw}) > 0 THEN {q(TX.LABEL_KEYWORDS)} || {kw_txt} END",
    ])
    joined = f"concat_ws({q(TX.PART_SEPARATOR)}, {parts})"
    return (f"CASE WHEN {joined} <> '' THEN {joined} "
            f"ELSE coalesce(CAST({insight} AS VARCHAR), 'None') END")


def query_text(query: str, collection_sql: str) -> str:
    return (f"CASE WHEN {collection_sql} = {q(TX.KNOWLEDGE_COLLECTION)} "
            f"THEN {q(TX.QUERY_PREFIX_KNOWLEDGE)} ELSE {q(TX.QUERY_PREFIX_OTHER)} END "
            f"|| coalesce(CAST({query} AS VARCHAR), '')")


def not_blank(expr: str) -> str:
    return f"({expr} IS NOT NULL AND regexp_replace({expr}, {q(TX.WS_RUN)}, '', 'g') <> '')"


def hash_embed_ctes(prefix: str, source_sql: str, dim: int) -> str:
    """CTEs ``<prefix>_nv(k, b, v)``: the non-zero components of the hashing
    embedder's vectors for ``source_sql`` rows ``(k, t)``; blank texts left out.

    Same rule as the Arrow UDF: code-point trigrams (short texts padded with
    0), polynomial hash mod 2^31-1 mod dim, counts L2-normalised to FLOAT.
    """
    from ..operators.embedding import HASH_BASE, HASH_MODULUS
    p, p2, m = HASH_BASE, HASH_BASE * HASH_BASE, HASH_MODULUS
    return f"""
{prefix}_src AS (SELECT k, t FROM ({source_sql}) WHERE {not_blank('t')}),
{prefix}_cp AS (SELECT k, list_transform(string_split(t, ''), lambda c: CAST(unicode(c) AS BIGINT)) AS c
          FROM {prefix}_src),
{prefix}_pd AS (SELECT k, CASE WHEN len(c) < 3 THEN list_concat(c, list_transform(range(3 - len(c)),
                lambda x: CAST(0 AS BIGINT))) ELSE c END AS c FROM {prefix}_cp),
{prefix}_g AS (SELECT k, unnest(list_transform(range(1, len(c) - 1),
                lambda i: ((c[i] * {p2} + c[i + 1] * {p} + c[i + 2]) % {m}) % {dim})) AS b FROM {prefix}_pd),
{prefix}_cnt AS (SELECT k, b, CAST(count(*) AS DOUBLE) AS n FROM {prefix}_g GROUP BY k, b),
{prefix}_nv AS (SELECT k, b, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY k)) AS FLOAT) AS v
          FROM {prefix}_cnt)"""


def dense_vectors(prefix: str, dim: int) -> str:
    """CTE ``<prefix>_vec(k, vec)``: dense FLOAT[dim] lists from ``<prefix>_nv``."""
    return f"""
{prefix}_keys AS (SELECT DISTINCT k FROM {prefix}_nv),
{prefix}_full AS (SELECT kk.k, r.b, coalesce(nv.v, CAST(0 AS FLOAT)) AS v
          FROM {prefix}_keys kk CROSS JOIN (SELECT range AS b FROM range({dim})) r
          LEFT JOIN {prefix}_nv nv ON nv.k = kk.k AND nv.b = r.b),
{prefix}_vec AS (SELECT k, list(v ORDER BY b) AS vec FROM {prefix}_full GROUP BY k)"""
