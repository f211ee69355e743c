"""The driver's queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import chat, cover_tree, decontaminate, html_text, langid, ngram_join, pack, token_io, toxicity, warc
from .sampling import crc_of_id


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack.pack(_table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", (F.pmod(crc_of_id(), F.lit(3)) == 1).alias("held_out"), "lang_pred", "score", "spans")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_preferences(chat.swapped_replies(_table(spark, sf_dir, "conversations")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", (F.pmod(crc_of_id(), F.lit(5)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_pages(_table(spark, sf_dir, "pages"))
    found = warc.read_records(spark, folder, payload=False, verify=True).where(F.col("record_type").isin("response", "revisit"))
    return found.select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("refers_to"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(_table(spark, sf_dir, "embeddings"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = token_io.read_ids(token_io.write_ids(_table(spark, sf_dir, "documents")))
    return back.select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_language_id": op3_language_id,
    "op4_decontaminate": op4_decontaminate,
    "op5_chat_format": op5_chat_format,
    "op6_toxicity": op6_toxicity,
    "op7_warc": op7_warc,
    "op8_html_text": op8_html_text,
    "op9_cover_tree_topk": op9_cover_tree_topk,
    "op10_token_ids": op10_token_ids,
}

ORACLES = {"op2_ngram_jaccard_join": ngram_join.SQL, "op7_warc": warc.SQL, "op5_chat_format": chat.SQL, "op9_cover_tree_topk": cover_tree.SQL}
