"""Registered queries against their SQL, on the smallest tables."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = [
    "bank_chunks", "normalized_text", "internal_percent", "filtered_text", "style_score", "search_queries", "page_text",
    "recent_documents", "login_lookup", "merged_sessions", "web_excerpt", "upload_validation", "internal_pairs", "web_pairs",
    "rls_reports", "rls_certificates", "resolved_owners", "available_students", "document_rows", "issued_certificates",
    "institution_percent", "active_certificates", "page_text_planted", "docx_round_trip", "reindexed_bank", "certificate_paths", "certificate_search_facets", "asof_percent", "replaced_findings", "search_results", "web_candidates", "searched_percent", "job_states", "check_violations", "default_orders", "report_web_findings",
]


@pytest.fixture(scope="module")
def sql():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, sql, name):
    df = __spark_entry__.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    relation = sql.sql(__spark_entry__.oracle_sql()[name])
    at = [relation.columns.index(c) for c in columns]
    assert got == Counter(tuple(r[i] for i in at) for r in relation.fetchall())


def test_every_query_has_sql():
    missing = set(__spark_entry__.queries()) - set(__spark_entry__.oracle_sql())
    assert all(q == "pipeline" or q.startswith("op") for q in missing)


def test_analysis_matches_sql(spark, sql):
    test_query_matches_sql(spark, sql, "analysis_percents")


def test_analysis_leaves_out_what_the_filter_drops(spark, tmp_path):
    """Two documents share a reference list only: it is no match, and not part of what is measured."""
    own = [" ".join(f"{stem}{i}" for i in range(200)) for stem in ("casa", "mesa")]
    tail = "Referencias " + " ".join(f"fuente{i}" for i in range(90))
    rows = [(i, f"{text}\n{tail}") for i, text in enumerate(own)] + [(2, own[0])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.doc_id: r for r in __spark_entry__.queries()["analysis_percents"](spark, str(tmp_path)).collect()}
    raw = {r.doc_id: r.similarity_percent for r in __spark_entry__.queries()["internal_percent"](spark, str(tmp_path)).collect()}
    assert raw[1] > 0 and got[1].internal_percent == got[1].total_percent == 0 and got[1].risk_level == "LOW"
    assert got[0].internal_percent == 100 and raw[0] == 100 and got[2].internal_percent > 0


def test_prefetched_order_rows_match_sql_and_the_lists(spark, sql):
    test_query_matches_sql(spark, sql, "prefetched_order_rows")
    found = {}
    for r in __spark_entry__.queries()["prefetched_order_rows"](spark, SF_DIR).collect():
        found.setdefault(r.c_custkey, []).append("" if r.o_orderkey is None else str(r.o_orderkey))
    lists = {r.c_custkey: r.orders for r in __spark_entry__.queries()["prefetched_orders"](spark, SF_DIR).collect()}
    assert {c: ",".join(x) for c, x in found.items()} == lists
    plan = __spark_entry__.queries()["prefetched_order_rows"](spark, SF_DIR)._jdf.queryExecution().toString()
    assert "rangepartitioning" in plan and "collect_list" not in plan


def test_planted_pages_with_cut_titles_match_sql(spark, tmp_path):
    """Titles and headings that end within an entity, before markup that is planted."""
    folder = str(tmp_path)
    pages = [(i, f"http://a.org/{i}", f"<title>t {i} &amp;&{'amp'[: i % 4]}</title><article><h1>h &amp;&quo</h1>{'word ' * 150}&amp</article>") for i in range(10)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    for name in ("page_text_planted", "page_text"):
        same_as_sql(spark, c, name, folder)


def same_as_sql(spark, c, name, folder):
    df = __spark_entry__.queries()[name](spark, folder)
    columns = sorted(df.columns)
    relation = c.sql(__spark_entry__.oracle_sql()[name])
    at = [relation.columns.index(x) for x in columns]
    assert Counter(tuple(r[x] for x in columns) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in relation.fetchall())
