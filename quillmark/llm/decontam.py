"""Benchmark decontamination: windows of benchmark words, hashed and broadcast, met by every window of the documents.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. A
benchmark item gives all its windows of ``size`` words, or one window of all its
words if it has fewer. A document's word hashes are one array of its row; each
place of it is a row for the length of one pipeline only, where the window's hash
is made of its neighbours and looked up in the broadcast set, so a window that is
not in the set costs a hash and a lookup and nothing is shuffled. Hits are verified
on the words themselves. The set is broadcast in parts of at most ``MOST_WINDOWS``
windows, each met by a pass over the documents.

Defined cases: a null text or item has no words and no hits; an empty benchmark
hits nothing; repeated items all count; every row of the documents gives a row,
also rows that share an id or have none; other columns, whatever their names, are
left out by ``contamination`` and kept by ``clean_documents``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.runtime import checkpoint, plainly_named

SIZE = 10
#: Windows that are broadcast at once: about 200 MB.
MOST_WINDOWS = 1_000_000
#: Contaminated texts whose digests are broadcast at most: about 100 MB.
MOST_TEXTS = 1_000_000

# What is folded, and what is a word. The class is a positive one, as negated ones take seven times as long.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def raw_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def folded(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_hashes(words: str) -> Column:
    """Hashes of words in lower case: words that are equal once A-Z is folded have equal hashes."""
    return F.expr(f"transform({words}, x -> xxhash64(lower(x)))")


def _window_hash(size: int, start: str) -> Column:
    """Hash of the window of ``size`` words at ``start``, from the array ``h`` of word hashes."""
    inner = ", ".join(f"get(h, {start} + {k})" for k in range(size))
    return F.expr(f"xxhash64({inner}, {size})")


def _slice_of(words: str, start: str, size: str) -> Column:
    return F.expr(f"array_join(slice({words}, {start} + 1, {size}), ' ')")


def benchmark_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """(item_id, size, hash, words): the windows of each item, without repeats."""
    items = benchmark.select("item_id", raw_words(F.col("text")).alias("w")).where("size(w) > 0")
    items = items.withColumn("h", word_hashes("w")).withColumn("size", F.least(F.size("w"), F.lit(size)))
    each = items.select("*", F.explode(F.expr("sequence(0, size(w) - size)")).alias("start"))
    value = F.lit(None).cast("long")
    for n in range(1, size + 1):
        value = F.when(F.col("size") == n, _window_hash(n, "start")).otherwise(value)
    return each.select("item_id", "size", value.alias("hash"), folded(_slice_of("w", "start", "size")).alias("words")).distinct()


def _met(rows: DataFrame, known: DataFrame, sizes: list[int], whole: bool) -> DataFrame:
    """``rows`` (with the array ``w``) at each window that is in ``known``, as (…, size, start, words).

    With ``whole`` each row is given once more, with null in these columns.
    """
    others = [c for c in rows.columns if c != "w"]
    rows = rows.withColumn("h", word_hashes("w")).withColumn("n_words", F.size("w").cast("long"))
    # one more place in front stands for the whole row
    rows = rows.select(*others, "w", "n_words", "h", F.posexplode(F.expr("concat(array(0L), h)")).alias("place", "unused")).drop("unused")
    if not whole:
        rows = rows.where("place > 0")
    if len(sizes) > 1:
        rows = rows.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes]))).where(f"place > 0 or size = {sizes[0]}")
    else:
        rows = rows.withColumn("size", F.lit(sizes[0]))
    value = F.lit(None).cast("long")
    for n in sizes:
        value = F.when((F.col("size") == n) & (F.col("place") > 0) & (F.col("place") + (n - 1) <= F.col("n_words")), _window_hash(n, "place - 1")).otherwise(value)
    each = rows.select(*others, "n_words", "w", "place", "size", value.alias("hash"))
    known = known.select("hash", F.col("size").alias("of_size"), F.col("words").alias("gram"))
    each = each.join(F.broadcast(known), "hash", "left" if whole else "inner")
    same = (F.col("of_size") == F.col("size")) & (folded(_slice_of("w", "place - 1", "size")) == F.col("gram"))
    hit = F.col("gram").isNotNull() & F.coalesce(same, F.lit(False))
    each = each.where((F.col("place") == 0) | hit)
    return each.select(
        *others,
        "n_words",
        F.when(hit, F.col("size")).alias("size"),
        F.when(hit, F.col("place") - 1).alias("start"),
        F.when(hit, F.col("gram")).alias("words"),
    )


def hits(docs: DataFrame, grams: DataFrame, others: list[Column], whole: bool) -> DataFrame:
    """A row for each verified window of ``grams`` in a text of ``docs``: (others, n_words, size, start, words).

    With ``whole`` there is also a row of each document, with nulls. ``others`` must come out the same in each pass,
    if the windows take more than one.
    """
    known = grams.select("size", "hash", "words").distinct()
    sizes = sorted(r[0] for r in known.select("size").distinct().collect()) or [SIZE]
    passes = -(-known.count() // MOST_WINDOWS) or 1
    rows = docs.select(*others, raw_words(F.col("text")).alias("w"))
    each = [
        _met(rows, known.where(F.pmod("hash", F.lit(passes)) == k) if passes > 1 else known, sizes, whole and k == 0)
        for k in range(passes)
    ]
    return reduce(DataFrame.union, each)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated) of every row of ``docs`` (doc_id, text).

    ``n_hit`` counts words inside any occurrence of a window of ``benchmark`` (item_id, text), ``items`` is the
    sorted array of the items, as strings, of which a window occurs.
    """
    grams = checkpoint(benchmark_windows(benchmark, size))
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    if grams.count() > MOST_WINDOWS:
        rows = checkpoint(rows)  # numbers must be the same in each pass
    # written once: the numbers are then fixed, and the texts are read a single time
    found = checkpoint(hits(rows, grams, [F.col("row"), F.col("doc_id")], True))
    earlier = Window.partitionBy("row").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    spans = found.where("size is not null").select("row", "words", "start", "size")
    covered = end - F.greatest("start", F.coalesce(F.max(end).over(earlier), F.lit(0)))
    counts = spans.select("row", F.greatest(covered, F.lit(0)).alias("new")).groupBy("row").agg(F.sum("new").cast("long").alias("n_hit"))
    named = grams.select("words", F.col("item_id").cast("string").alias("item")).distinct()
    met = spans.select("row", "words").distinct().join(named, "words").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    rows = found.where("size is null").select("row", "doc_id", "n_words").join(counts.join(met, "row"), "row", "left")
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not contaminated.

    Rows are judged by their text, of which a digest goes around: also rows without an id, or with a repeated one.
    """
    grams = checkpoint(benchmark_windows(benchmark, size))
    key = F.sha2(F.col("text").cast("binary"), 256)
    gone = checkpoint(hits(docs, grams, [key.alias("digest")], False).select("digest").distinct())
    if gone.count() <= MOST_TEXTS:
        gone = F.broadcast(gone)
    rows = plainly_named(docs, ("text",)).withColumn("digest", key)
    return rows.join(gone, "digest", "left_anti").drop("digest").toDF(*docs.columns)
