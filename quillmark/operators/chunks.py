"""Overlapping word windows with offsets, and their shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.params import SHINGLE_WORDS, Windowing


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, ix, token, start_offset, end_offset) of every token of ``docs`` (doc_id, text)."""
    units = F.regexp_extract_all("text", F.lit(rf"(?s)(.*?)({T.TOKEN})"), F.lit(0))
    each = docs.select("doc_id", "text", units.alias("unit"))
    each = each.withColumn("token", F.regexp_extract_all("text", F.lit(T.TOKEN), F.lit(0))).select(
        "doc_id", F.posexplode_outer(F.arrays_zip("unit", "token")).alias("ix", "x")
    ).where("x is not null")
    before = Window.partitionBy("doc_id").orderBy("ix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("x.unit")).over(before)
    return each.select("doc_id", "ix", "x.token", (end - F.length("x.token")).alias("start_offset"), end.alias("end_offset"))


def chunks(docs: DataFrame, w: Windowing, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, chunk_ix, start_offset, end_offset, word_count, text_excerpt, normalized_text, content_hash).

    Runs without a shuffle: lengths of tokens with the gap before them are an array of the document's row; running
    totals are taken at window starts only, and a window sums its own slice. A text is normalised once, if each of its
    words is a token, and a window takes its words from there; otherwise each window is normalised by itself.
    """
    rows = docs.where(f"{id_col} is not null and text is not null").select(
        id_col, "text", F.regexp_extract_all("text", F.lit(rf"(?s)(.*?)({T.TOKEN})"), F.lit(0)).alias("units")
    )
    rows = rows.withColumn("u", F.transform("units", F.length))
    strides = f"transform(sequence(0, greatest(size(u) - 1, 0) div {w.step}), s -> aggregate(slice(u, s * {w.step} + 1, {w.step}), 0, (a, x) -> a + x))"
    rows = rows.withColumn("strides", F.expr(strides))
    window = f"""case when size(u) >= {w.least} then transform(sequence(0, (size(u) - {w.least}) div {w.step}), i -> struct(
      i as ix,
      aggregate(slice(strides, 1, i), 0, (a, x) -> a + x) as base,
      u[i * {w.step}] - length(regexp_extract(units[i * {w.step}], '[{T.TOKEN_CLASS}]+$', 0)) as gap,
      aggregate(slice(u, i * {w.step} + 1, {w.size}), 0, (a, x) -> a + x) as span,
      least({w.size}, size(u) - i * {w.step}) as n)) end"""
    upto = F.expr("substring(text, 1, aggregate(strides, 0, (a, x) -> a + x))")
    rows = rows.withColumns({"windows": F.expr(window), "words": F.split(T.normalized(upto), " ")})
    # outer, as a filter on the size of the array would be pushed through all that makes it
    each = rows.select(id_col, "text", "words", F.size("u").alias("tokens"), F.explode_outer("windows").alias("x")).where("x is not null")
    each = each.select(
        id_col,
        F.col("x.ix").alias("chunk_ix"),
        (F.col("x.base") + F.col("x.gap")).alias("start_offset"),
        (F.col("x.base") + F.col("x.span")).alias("end_offset"),
        F.col("x.n").alias("word_count"),
        "text",
        "words",
        "tokens",
    )
    excerpt = F.expr("substring(text, start_offset + 1, end_offset - start_offset)")
    each = each.withColumn("text_excerpt", excerpt)
    # never empty, as each token leaves a word
    own = F.array_join(F.slice("words", F.col("chunk_ix") * w.step + 1, F.col("word_count")), " ")
    normalized = F.when(F.size("words") == F.col("tokens"), own).otherwise(T.normalized(F.col("text_excerpt")))
    each = each.withColumn("normalized_text", normalized).drop("text", "words", "tokens")
    return each.withColumn("content_hash", F.sha2("normalized_text", 256))


def shingles(words: str) -> str:
    """SQL for the distinct 4-word shingles of a word array, or the distinct words if there are fewer."""
    joined = ", ".join(f"{words}[i + {k}]" for k in range(SHINGLE_WORDS))
    return (
        f"array_distinct(case when size({words}) < {SHINGLE_WORDS} then {words} else "
        f"transform(sequence(0, size({words}) - {SHINGLE_WORDS}), i -> concat_ws(' ', {joined})) end)"
    )


def with_shingles(rows: DataFrame) -> DataFrame:
    """``rows`` with the array ``shingles`` of their ``normalized_text``."""
    rows = rows.withColumn("__w", F.filter(F.split("normalized_text", " "), lambda x: x != ""))
    return rows.withColumn("shingles", F.expr(shingles("__w"))).drop("__w")
