"""Row scopes of users, searches, and data-quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible_to(documents: DataFrame, user_id, role: str, is_superuser: bool = False, institution_id=None) -> DataFrame:
    """Documents (owner_id, institution_id) that a user may see: students their own, others their institution's, superusers all.

    The rule for students comes first; a user of no institution who is neither sees nothing.
    """
    if role == "STUDENT":
        return documents.where(F.col("owner_id") == F.lit(user_id))
    if is_superuser:
        return documents
    return documents.where(F.col("institution_id") == F.lit(institution_id))


def visible_through(rows: DataFrame, parents: list[tuple[DataFrame, str, str]], user_id, role: str, is_superuser: bool = False, institution_id=None) -> DataFrame:
    """``rows`` whose document a user may see; ``parents`` lead to it as (table, the child's column, the table's own column), the documents last.

    The scope is put on the documents, and what is left of each table meets its children by a semi-join.
    """
    *between, (documents, child, own) = parents
    seen = visible_to(documents, user_id, role, is_superuser, institution_id).select(F.col(own).alias(child))
    for table, fk, pk in reversed(between):
        seen = table.join(seen, child, "left_semi").select(F.col(pk).alias(fk))
        child = fk
    return rows.join(seen, child, "left_semi")


def login(users: DataFrame, name: str) -> DataFrame:
    """The user whose name or mail address it is, whatever the case; of several the first by name."""
    low = F.lower(F.lit(name))
    found = users.where((F.lower("username") == low) | (F.lower("email") == low)).select("username", "is_active")
    return found.orderBy("username", "is_active").limit(1)


def search(rows: DataFrame, terms: str, fields: list[str]) -> DataFrame:
    """Rows of which every term occurs in some field, whatever the case."""

    def anywhere(term: str) -> Column:
        return reduce(lambda a, b: a | b, [F.lower(F.col(f)).contains(term.lower()) for f in fields])

    return rows.where(reduce(lambda a, b: a & b, [anywhere(t) for t in terms.split()], F.lit(True)))


TRIGRAM = 3


def _trigrams(text: Column) -> Column:
    """Distinct runs of three characters of the lower-cased text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (TRIGRAM - 1), F.lit(1))), lambda i: F.substring(F.lower(text), i, F.lit(TRIGRAM))))


def trigram_index(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(gram, key): the rows of which some field has each run of three characters."""
    each = rows.select(key, F.explode(F.array(*[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])).alias("value"))
    return each.select(F.explode_outer(_trigrams(F.col("value"))).alias("gram"), key).where(F.length("gram") == TRIGRAM).distinct()


def indexed_search(rows: DataFrame, index: DataFrame, terms: str, key: str, fields: list[str]) -> DataFrame:
    """As ``search``: rows that have all runs of the longer terms by the index, and hold every term on a look at their fields.

    Terms of fewer than three characters have no run; they are looked for in what the others leave.
    """
    grams = sorted({t.lower()[i : i + TRIGRAM] for t in terms.split() for i in range(len(t) - TRIGRAM + 1)})
    if grams:
        held = index.where(F.col("gram").isin(grams)).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
        rows = rows.join(held.select(key), key, "left_semi")
    return search(rows, terms, fields)


def faceted(rows: DataFrame, facets: list[str]) -> DataFrame:
    """(facet, value, n): how many rows have each value of each facet, in one pass."""
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets])).alias("x"))
    return each.groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that a uniqueness constraint finds more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
