"""Removal of multi-line chunks that occur earlier in the corpus.

Lines are cut at newlines. A rolling hash runs over the hashes of a line and the
line before; a chunk ends after each line where it is lower than at both
neighbours, so that a cut depends on four lines around it and an inserted line
moves no other cut. Chunks of two or more lines with any visible character are
grouped by hash; the first, by document id and place, stays. Before others go,
the bytes of a group are compared by the smallest and the largest of its texts;
where these differ, the group is split by the text itself.

Defined cases: a null text is an empty one, which has one empty line; text without
a repeated chunk is returned as it is; a row without an id keeps its text and is
nobody's earlier copy; rows that share an id do not precede each other. Columns
other than id and text, whatever their names, are kept by ``drop_repeats`` (save
for ``n_lines`` and ``n_removed``, which it makes) and left out elsewhere. An
empty table gives no rows. A hash that many chunks have is met by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.runtime import checkpoint, met_by_groups

#: Low bits of a chunk's key that hold its place in the document; the others are of its hash.
PLACE_BITS = 28
KEYS = f"transform(chunks, (c, i) -> shiftleft(xxhash64(c), {PLACE_BITS}) | cast(i as bigint))"
KEY = f"shiftleft(hash, {PLACE_BITS}) | cast(ix as bigint)"
PLACE = "struct(doc_id, ix)"


def with_chunks(docs: DataFrame) -> DataFrame:
    """``docs`` with the array ``chunks`` of the text's chunks, each with its newlines inside.

    Every line gets a flag in front, 1 where a chunk begins; cutting at a newline and a 1 is then unambiguous.
    """
    out = docs.withColumn("__line", F.expr(r"split(coalesce(text, ''), '\n', -1)"))
    out = out.withColumn("__hash", F.expr("transform(__line, x -> md5(x))"))
    out = out.withColumn(
        "__roll", F.expr("transform(__hash, (x, i) -> case when i > 0 then md5(concat(__hash[i - 1], x)) end)")
    )
    begins = "i = 0 or (i > 2 and coalesce(__roll[i - 1] < __roll[i - 2] and __roll[i - 1] < __roll[i], false))"
    flagged = rf"transform(__line, (x, i) -> concat(if({begins}, '\n1', '\n0'), x))"
    out = out.withColumn("__flagged", F.array_join(F.expr(flagged), ""))
    cut = r"transform(slice(split(__flagged, '\n1', -1), 2, 1000000000), c -> replace(c, '\n0', '\n'))"
    return out.withColumn("chunks", F.expr(cut)).drop("__line", "__hash", "__roll", "__flagged")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, keys): per document the keys of its chunks that occur earlier."""
    live = docs.where("doc_id is not null").select("doc_id", "text")
    # outer, as a filter on the size of the array would be pushed through all that makes it
    each = with_chunks(live).select("doc_id", F.posexplode_outer("chunks").alias("ix", "c"))
    each = each.where(F.col("c").contains("\n") & F.col("c").rlike(r"\S"))
    each = checkpoint(each.select("doc_id", "ix", F.xxhash64("c").alias("hash")))
    groups = each.groupBy("hash").agg(F.min(F.expr(PLACE)).alias("first"), F.count("*").alias("times")).where("times > 1")
    groups = checkpoint(groups)
    # the bytes of all chunks in groups, read once a document
    found = met_by_groups(each, groups.select("hash", "times"), "hash", "times")
    wanted = found.groupBy("doc_id").agg(F.collect_set(F.expr(KEY)).alias("keys"))
    texts = with_chunks(live.join(wanted, "doc_id"))
    places = F.expr(f"transform(array_intersect({KEYS}, keys), k -> cast(k & {(1 << PLACE_BITS) - 1} as int))")
    texts = texts.withColumn("places", places).select("doc_id", F.explode_outer(F.expr("transform(places, i -> struct(i as ix, chunks[i] as c))")).alias("x"))
    texts = texts.select("doc_id", "x.ix", F.xxhash64("x.c").alias("hash"), "x.c").where("c is not null")
    sides = texts.groupBy("hash").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    verdict = checkpoint(sides.select("hash", (F.col("lo") == F.col("hi")).alias("same")))
    plain = met_by_groups(each, groups.join(verdict.where("same"), "hash"), "hash", "times")
    plain = plain.where(f"{PLACE} <> first").select("doc_id", "ix", "hash")
    if verdict.where("not same").isEmpty():
        return plain.groupBy("doc_id").agg(F.collect_set(F.expr(KEY)).alias("keys"))
    mixed = texts.join(verdict.where("not same").select("hash"), "hash")
    firsts = mixed.groupBy("hash", "c").agg(F.min(F.expr(PLACE)).alias("first"))
    split = mixed.join(firsts, ["hash", "c"]).where(f"{PLACE} <> first").select("doc_id", "ix", "hash")
    return plain.union(split).groupBy("doc_id").agg(F.collect_set(F.expr(KEY)).alias("keys"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with ``text`` rid of repeated chunks, and ``n_lines``, ``n_removed`` (lines).

    A null text stays null. The caller's columns travel in one structure, so that their names may be any.
    """
    others = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    name = {c: "`" + c.replace("`", "``") + "`" for c in others}
    gone = repeated_chunks(docs).select(F.col("doc_id").alias("id"), "keys")
    rows = docs.select(F.struct(*[F.col(name[c]) for c in others]).alias("row"), "doc_id", F.col("text").alias("whole"))
    rows = rows.join(gone, F.col("doc_id") == F.col("id"), "left").select("row", "whole", "keys")
    touched = F.col("keys").isNotNull()
    rows = with_chunks(rows.withColumn("text", F.when(touched, F.col("whole"))))
    left = f"transform(array_except({KEYS}, keys), k -> chunks[cast(k & {(1 << PLACE_BITS) - 1} as int)])"
    rows = rows.withColumn("left", F.expr(left))
    kept = F.array_join("left", "\n")
    n = F.size(F.split(F.coalesce("whole", F.lit("")), "\n", -1)).cast("long")
    n_left = F.when(F.size("left") == 0, 0).otherwise(F.size(F.split(kept, "\n", -1))).cast("long")
    return rows.select(
        *[F.when(touched, kept).otherwise(F.col("whole")).alias(c) if c == "text" else F.col(f"row.{name[c]}").alias(c) for c in others],
        n.alias("n_lines"),
        F.when(touched, n - n_left).otherwise(0).cast("long").alias("n_removed"),
    )
