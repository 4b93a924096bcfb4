"""Queries that apply each operator with production parameters to its whole table, and the SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm import checks_sql as sql
from frameloom.llm import (
    ball_codes,
    graph_search,
    importance,
    language_id,
    mixing,
    ngram_join,
    packing,
    phrase_mining,
    pseudo_likelihood,
    quality_rules,
    topk_search,
    toxicity,
    url_filters,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_rules", sql.QUALITY)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select("row.doc_id", "quality.*")


@query("op3_topk")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk_search.search(rows, rows.where("vec_id % 20 = 0"))


@query("op5_pack")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op6_mix", sql.MIX)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sizes(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("takes")).alias("taken"))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(toxicity.remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    scored = toxicity.score(docs, model).select("row.doc_id", "score")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op8_ngram_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), size=3, percent=90, spread=2.0)


@query("op2_url_filters")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("row.page_id", "host", "path", "rule", "verdict", "block_score")


@query("op4_importance")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return importance.resample(table(spark, sf_dir, "documents"), target, share=0.85)


@query("op9_pseudo_likelihood")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = pseudo_likelihood.score(docs, pseudo_likelihood.train(docs))
    mean = (F.col("log_likelihood") / F.greatest(F.col("n_words"), F.lit(1))).alias("mean_log_likelihood")
    return scored.select("row.doc_id", "n_words", "log_likelihood", mean)


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = language_id.train(docs)
    held_out = F.coalesce(toxicity.remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    found = language_id.identify(docs.select("doc_id", "text"), field).select("row.doc_id", "lang_pred", "score")
    return found.select("doc_id", held_out, "lang_pred", "score")


@query("op13_ball_codes")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_codes.encode(table(spark, sf_dir, "embeddings"))


@query("op12_graph_search")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found = graph_search.search(graph_search.index(rows), rows.where("vec_id % 50 = 0"))
    return found.select("query_id", "rank", "vec_id", "score")


@query("op11_phrase_mining", sql.PHRASES)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, sf_dir, "documents"))
