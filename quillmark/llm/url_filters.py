"""Captures judged by the URL-list entries in force when they were fetched.

A list is a table of dated entries (domain, action 'add' or 'remove', since). The
entries of a domain in order of date become validity intervals [since, until); of
entries of the same moment the removal counts. A capture asks for its host and
every parent domain: distinct (host, moment) pairs are taken first, so a common
host is asked once a moment, and their suffixes meet the intervals by an equi-join
on the domain with the interval as a further condition.

Defined cases: a null or unparsable URL has the host '' and is not blocked; a null
moment is not blocked; list rows with nulls count for nothing; an empty list blocks
nothing; repeated rows are judged alike; a host is lower-cased, without port, user
and a final dot. Other columns of the captures are kept, save for those that the
result names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Intervals that are broadcast at most: about 100 MB.
MOST_INTERVALS = 1_000_000


def host(url: Column) -> Column:
    """Lower-cased host name of a URL, '' if there is none."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    name = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    return F.lower(F.regexp_replace(name, r"\.$", ""))


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, since, until): when each domain is listed; ``until`` null if it still is."""
    sound = entries.where("domain is not null and since is not null and action in ('add', 'remove')")
    sound = sound.select(F.lower("domain").alias("domain"), "since", "action")
    state = sound.groupBy("domain", "since").agg(F.max("action").alias("action"))
    following = F.lead("since").over(Window.partitionBy("domain").orderBy("since"))
    return state.withColumn("until", following).where("action = 'add'").select("domain", "since", "until")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """``captures`` with ``host``, ``blocked`` and ``entry``, the longest listed domain in force (null if none)."""
    rules = intervals(entries)
    if rules.count() <= MOST_INTERVALS:
        rules = F.broadcast(rules)
    names = [c for c in captures.columns if c not in ("host", "blocked", "entry")]
    columns = [f"c{i}" for i, c in enumerate(captures.columns) if c in names]
    rows = captures.toDF(*[f"c{i}" for i in range(len(captures.columns))])
    at = f"c{captures.columns.index(fetched)}"
    rows = rows.withColumn("host", host(F.col(f"c{captures.columns.index(url)}")))
    asked = rows.select("host", F.col(at).alias("at")).where("at is not null and host <> ''").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = asked.select("host", "at", F.explode(suffixes).alias("domain"))
    met = each.join(rules, "domain").where("at >= since and (until is null or at < until)")
    best = met.groupBy("host", "at").agg(F.max(F.struct(F.length("domain").alias("n"), "domain")).alias("best"))
    best = best.select(F.col("host").alias("of_host"), F.col("at").alias("of_at"), F.col("best.domain").alias("entry"))
    out = rows.join(best, (F.col("host") == F.col("of_host")) & (F.col(at) == F.col("of_at")), "left")
    return out.select(*columns, "host", F.col("entry").isNotNull().alias("blocked"), "entry").toDF(*names, "host", "blocked", "entry")
