"""Text column functions (T1-T5, T7, T8): JVM-side expressions, no UDFs.

Every function takes and returns a :class:`Column`, so Catalyst keeps them in
whole-stage codegen next to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour).
#
# Whitespace: the characters Python's str.isspace() / regex \s accept.
# Written as explicit code points so Java regex and RE2 read them the same.
WHITESPACE_CLASS = (r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# Characters kept by clean_text: word characters, CJK 4E00-9FFF, digits,
# . , ! ? ； ： " （ ） 【 】, whitespace, and four emoji blocks
# (1F600-1F64F, 1F300-1F5FF, 1F680-1F6FF, 1F1E0-1F1FF).
KEEP_CLASS = (r"\p{L}\p{N}_\x{4E00}-\x{9FFF}0-9.,!?；：\"（）【】" + WHITESPACE_CLASS
              + r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}")
# Punctuation whose immediate repeats collapse to one.
REPEAT_PUNCT = ",.!?；："
# Labels and separators of the embedding texts.
LABEL_ASPECT = "维度："
LABEL_INSIGHT = "观点："
LABEL_SENTIMENT = "情感："
LABEL_DESCRIPTION = "描述："
LABEL_EXAMPLES = "例子："
LABEL_KEYWORDS = "关键词："
PART_SEPARATOR = " | "
EXAMPLE_SEPARATOR = " | "
KEYWORD_SEPARATOR = " "
MAX_EXAMPLES = 3
UNKNOWN_CONTENT = "未知内容"
EMPTY_FEEDBACK = "空内容"
LABEL_SUMMARY = "摘要："
LABEL_ORIGINAL = "原文："
LABEL_FEEDBACK = "用户反馈："
QUERY_PREFIX_KNOWLEDGE = "查询: "
QUERY_PREFIX_OTHER = "用户反馈: "
KNOWLEDGE_COLLECTION = "knowledge"
# ---------------------------------------------------------------------------

# The same whitespace set as literal characters (for btrim).
WHITESPACE_CHARS = "".join(
    [chr(c) for c in range(0x09, 0x0E)] + [chr(c) for c in range(0x1C, 0x21)]
    + ["\x85", "\xa0", "\u1680"] + [chr(c) for c in range(0x2000, 0x200B)]
    + ["\u2028", "\u2029", "\u202f", "\u205f", "\u3000"])
WS_RUN = f"[{WHITESPACE_CLASS}]+"
DELETE_RE = f"[^{KEEP_CLASS}]"
REPEAT_RE = r"([,.!?；：])\1+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(x) -> Column:
    """null/empty -> ''; strip; collapse whitespace runs to one space;
    delete characters outside the keep class; collapse repeated , . ! ? ； ：;
    strip.  After the collapse every whitespace is a plain space, so the
    strips are ``trim`` of spaces."""
    s = F.coalesce(_c(x).cast("string"), F.lit(""))
    s = F.trim(F.regexp_replace(s, WS_RUN, " "))
    s = F.regexp_replace(s, DELETE_RE, "")
    s = F.regexp_replace(s, REPEAT_RE, "$1")
    return F.trim(s)


def _labelled(label: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(label), value))


def knowledge_text(aspect, insight, sentiment, description, examples, keywords,
                   *, insight_present=None, aspect_present=None,
                   insight_raw=None, aspect_raw=None, precleaned: bool = False) -> Column:
    """T2 + T3: labelled parts joined by ' | ', empty parts left out.

    ``examples``/``keywords`` are ``array<string>`` columns.  Examples: the first
    three, falsy ones dropped, each cleaned (values that clean to '' stay).
    Keywords: all non-empty ones, cleaned, joined by a space.  When no part
    is left the text falls back to insight if that key is present, else
    aspect if present, else ``未知内容`` (T3); an explicit JSON null prints as
    ``None`` there, as Python's ``str`` does.
    """
    parts = knowledge_parts(aspect, insight, sentiment, description, examples, keywords,
                            precleaned=precleaned)
    return _knowledge_final(parts, insight, aspect, insight_present, aspect_present,
                            insight_raw, aspect_raw)


def knowledge_parts(aspect, insight, sentiment, description, examples, keywords,
                    *, precleaned: bool = False) -> Column:
    """The labelled parts of T2 joined by ' | ' ('' when none is left)."""
    ex = F.filter(F.slice(F.coalesce(_c(examples), F.array()), 1, MAX_EXAMPLES),
                  lambda e: e.isNotNull() & (e != ""))
    kw = F.filter(F.coalesce(_c(keywords), F.array()), lambda e: e.isNotNull() & (e != ""))
    ex_txt = F.array_join(F.transform(ex, clean_text), EXAMPLE_SEPARATOR)
    kw_txt = F.array_join(F.transform(kw, clean_text), KEYWORD_SEPARATOR)
    cl = (lambda c: _c(c)) if precleaned else clean_text
    return F.concat_ws(
        PART_SEPARATOR,
        _labelled(LABEL_ASPECT, cl(aspect)),
        _labelled(LABEL_INSIGHT, cl(insight)),
        _labelled(LABEL_SENTIMENT, cl(sentiment)),
        _labelled(LABEL_DESCRIPTION, cl(description)),
        F.when(F.size(ex) > 0, F.concat(F.lit(LABEL_EXAMPLES), ex_txt)),
        F.when(F.size(kw) > 0, F.concat(F.lit(LABEL_KEYWORDS), kw_txt)),
    )


def _knowledge_final(parts, insight, aspect, insight_present, aspect_present,
                     insight_raw, aspect_raw) -> Column:
    """The parts, or the fallback when they are empty."""
    parts = _c(parts)
    ins_p = F.lit(True) if insight_present is None else _c(insight_present)
    asp_p = F.lit(True) if aspect_present is None else _c(aspect_present)
    ins_raw = _c(insight) if insight_raw is None else _c(insight_raw)
    asp_raw = _c(aspect) if aspect_raw is None else _c(aspect_raw)
    fallback = (F.when(ins_p, F.coalesce(ins_raw.cast("string"), F.lit("None")))
                .when(asp_p, F.coalesce(asp_raw.cast("string"), F.lit("None")))
                .otherwise(F.lit(UNKNOWN_CONTENT)))
    return F.when(parts != "", parts).otherwise(fallback)


def feedback_text(raw_text, summary) -> Column:
    """T4: '空内容' when the cleaned raw text is empty; else '摘要：s | 原文：r'
    when the cleaned summary is non-empty; else '用户反馈：r'."""
    raw = clean_text(raw_text)
    summ = clean_text(summary)
    return (F.when(raw == "", F.lit(EMPTY_FEEDBACK))
            .when(summ != "", F.concat(F.lit(LABEL_SUMMARY), summ, F.lit(PART_SEPARATOR),
                                       F.lit(LABEL_ORIGINAL), raw))
            .otherwise(F.concat(F.lit(LABEL_FEEDBACK), raw)))


def query_text(query, collection) -> Column:
    """T5: search text of a query; the query itself is not cleaned."""
    coll = F.lit(collection) if isinstance(collection, str) else collection
    prefix = F.when(coll == KNOWLEDGE_COLLECTION, F.lit(QUERY_PREFIX_KNOWLEDGE)) \
        .otherwise(F.lit(QUERY_PREFIX_OTHER))
    return F.concat(prefix, F.coalesce(_c(query).cast("string"), F.lit("")))


def is_blank(x) -> Column:
    """``not text or not text.strip()``.  ``btrim`` stops at the first
    non-blank character from each end, so long texts cost O(1)."""
    t = _c(x).cast("string")
    return t.isNull() | (F.btrim(t, F.lit(WHITESPACE_CHARS)) == "")


def text_hash(x) -> Column:
    """md5 hex of the UTF-8 text."""
    return F.md5(_c(x).cast("string"))


def text_length(x) -> Column:
    """Length in code points (Python ``len``)."""
    return F.char_length(_c(x)).cast("long")


# ---------------------------------------------------------------------------
# DataFrame-level builders.  Spark does not share a sub-expression between a
# CASE condition and its branches, so the Column forms above clean a field
# once per reference.  These add the cleaned fields as their own projection
# first (Catalyst keeps a non-cheap expression used twice in its own Project),
# so every regex runs once per field.
# ---------------------------------------------------------------------------

def with_feedback_text(df, raw_text, summary, out: str = "text_for_embedding"):
    t = (df.withColumn("__raw_c", clean_text(raw_text))
         .withColumn("__sum_c", clean_text(summary)))
    raw, summ = F.col("__raw_c"), F.col("__sum_c")
    txt = (F.when(raw == "", F.lit(EMPTY_FEEDBACK))
           .when(summ != "", F.concat(F.lit(LABEL_SUMMARY), summ, F.lit(PART_SEPARATOR),
                                      F.lit(LABEL_ORIGINAL), raw))
           .otherwise(F.concat(F.lit(LABEL_FEEDBACK), raw)))
    return t.withColumn(out, txt).drop("__raw_c", "__sum_c")


def with_knowledge_text(df, aspect, insight, sentiment, description, examples, keywords,
                        out: str = "text_for_embedding", **fallback):
    t = df
    names = []
    for i, c in enumerate((aspect, insight, sentiment, description)):
        t = t.withColumn(f"__k{i}", clean_text(c))
        names.append(f"__k{i}")
    t = t.withColumn("__parts", knowledge_parts(*[F.col(n) for n in names], examples, keywords,
                                                precleaned=True))
    txt = _knowledge_final("__parts", insight, aspect, fallback.get("insight_present"),
                           fallback.get("aspect_present"),
                           fallback.get("insight_raw", insight), fallback.get("aspect_raw", aspect))
    return t.withColumn(out, txt).drop(*names, "__parts")
