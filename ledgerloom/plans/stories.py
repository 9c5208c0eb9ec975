"""Queries over news: one row for each story."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import news
from ledgerloom.plans.registry import query, table


def news_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news: the first twelve words are the title, the page of that number the address, and ids give time and kind.

    A nineteenth of the items carry the address of another one, and copies of a text come hours apart.
    """
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    minutes = F.pmod(F.xxhash64("doc_id"), F.lit(60 * 24 * 30))
    items = docs.select(
        F.col("doc_id").alias("item_id"), F.regexp_extract("text", r"^(\S+(?: \S+){0,11})", 1).alias("title"), "source",
        (F.lit("2026-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=minutes.cast("int"))).alias("published"),
        F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 4).alias("security_id"), F.when(F.col("doc_id") % 5 == 0, "announcement").otherwise("news").alias("kind"),
        F.when(F.col("doc_id") % 19 == 0, F.floor(F.col("doc_id") / 2)).otherwise(F.col("doc_id")).alias("page_id"),
    )
    return items.join(pages.select("page_id", "url"), "page_id", "left").drop("page_id")


@query("nw_dedupe")
def nw_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark has the difference of strings in this form only in Python, and SQL hasn't; tests hold it against a plain pass."""
    return news.dedupe_news(news_items(spark, sf_dir)).select("item_id", F.array_join("also", ",").alias("also"), "folded")
