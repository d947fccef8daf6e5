"""The registered queries of the operators: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import alignment, bpe, collocations, decontam, embedding_dedup, line_dedup, minhash, secrets, substring_dedup, token_counts, toxicity, url_filters, warc
from quillmark.llm.oracle import ORACLE_SQL  # noqa: F401  registered beside the queries
from quillmark.llm.runtime import shared_folder, table


def tokenizer(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


BYTE_BPE, WORD_BPE, PIECE_BPE, TOKEN_LIMIT = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model", 2048


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE), packed=True)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.expr("filter(findings, f -> f.kind <> 'random')")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f.kind, f.start, f.end)), ",")

    counts = [F.size(F.expr(f"filter(findings, f -> f.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in secrets.KINDS[:3]]
    return found.select(
        "doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans")
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )


def dated_list(captures: DataFrame) -> DataFrame:
    """A list to judge the pages by, as a rule over their hosts and parent domains.

    A domain is listed if its MD5 begins with 0 or 1. Three further digits of it set the day of 2024 on which it is
    added; domains whose MD5 begins with 1 are removed after 30 days and added again after 60.
    """
    hosts = captures.select(url_filters.host(F.col("url")).alias("host")).where("host <> ''").distinct()
    domains = hosts.union(hosts.select(F.expr("substring_index(host, '.', -2)"))).distinct()
    digest = domains.select(F.col("host").alias("domain"), F.md5("host").alias("m")).where("m < '2'")
    day = F.expr("timestamp'2024-01-01' + make_dt_interval(cast(conv(substring(m, 2, 3), 16, 10) as int) % 366)")
    again = "array(struct('add' as action, 0 as d), struct('remove' as action, 30 as d), struct('add' as action, 60 as d))"
    steps = digest.select("domain", day.alias("day"), F.explode(F.expr(f"if(m < '1', slice({again}, 1, 1), {again})")).alias("x"))
    return steps.select("domain", "x.action", F.expr("day + make_dt_interval(x.d)").alias("since"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no time of their own: page_id hours after the start of 2024, over and over, stands for it."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.expr("timestamp'2024-01-01' + make_dt_interval(0, cast(page_id % 8784 as int))")
    judged = url_filters.judge(pages.withColumn("fetched", fetched), dated_list(pages))
    return judged.select("page_id", "host", F.date_format("fetched", "yyyy-MM-dd HH:mm:ss").alias("fetched"), "blocked", "entry")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer(WORD_BPE))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tokenizer(BYTE_BPE), tokenizer(PIECE_BPE)
    found = alignment.align(table(spark, sf_dir, "documents"), *paths)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    counted = alignment.with_pair_counts(found.withColumn("groups_sha256", digest).drop("groups"), paths[1])
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), path, "page_id", "url", "html")
    found = warc.records(warc.read(spark, path, data=False))
    return found.select(
        F.col("row_id").cast("long").alias("page_id"),
        F.col("n_bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_bpe_roundtrip": op4_bpe_roundtrip,
    "op5_secret_scans": op5_secret_scans,
    "op6_line_dedup": op6_line_dedup,
    "op7_url_filters": op7_url_filters,
    "op8_toxicity": op8_toxicity,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_token_counts": op10_token_counts,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_warc": op12_warc,
    "op13_collocations": op13_collocations,
}
