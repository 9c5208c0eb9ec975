"""Operator 1, mixing sources to target weights: Efraimidis-Spirakis order, prefix-summed to a budget per source."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ledgerloom.llm.bytewise import slices, word_counts
from ledgerloom.llm.staging import stage

#: Ranges of keys within a source; each is sorted and summed by itself, so that a hot source is no single task.
RANGES = 1024


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(word_counts(b.column(2))), b.column(3)], ["doc_id", "source", "size", "name"])


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and name of each row; the name is the id, or without one made from the text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    return docs.select("doc_id", "source", "text", name.alias("name")).mapInArrow(_sizes, "doc_id long, source string, size long, name string")


def exponential_key(weight: Column, seed: int) -> Column:
    """-ln(u) / weight for a u in (0, 1) that only the row's name and the seed decide; the smallest keys are taken first."""
    digest = F.md5(F.concat("name", F.lit(f":{seed}")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    return -F.ln(u) / weight


def source_targets(sums: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``target`` of each row (source, source_size): ``share`` of all sizes, divided by weight.

    Weights repeat over sources by code point, null last. A target above ``most`` times its source's size becomes that,
    and the excess is shared again by weight: the level at which the rest is dealt out is found from prefix sums over
    sources in the order in which they reach their limit. The windows see one row per source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = sums.select("source", "source_size", rank.alias("rank"), weight.alias("weight")).withColumn("limit", most * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    levels = ranked.withColumns(
        {
            "full": F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "rest": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
            "total": share * F.sum("source_size").over(everything),
        }
    ).withColumn("level", (F.col("total") - F.col("full")) / F.col("rest"))
    fits = F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.struct((F.col("limit") / F.col("weight")).alias("at"), "rank", "level"))
    level = F.coalesce(F.min(fits).over(everything)["level"], F.lit(float("inf")))
    return levels.select("source", "source_size", F.least(level * F.col("weight"), F.col("limit")).alias("target"))


def mix_sources(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """How many words of each row the mix takes: doc_id, source, size, source_size, target, epochs, taken.

    A source gives ``target // source_size`` complete epochs; the rest is filled by documents in the order of their
    exponential keys, whose rates are the quality weights, and the document at which the budget ends gives the words
    that are still missing, so that a source's words equal its rounded target. ``quality`` has doc_id and quality in
    [0, 1] (repeated rows are averaged); weights run from 1 to 4, a document without one has 2.5.

    Null and empty texts have size 0 and give 0 words. Null sources are one source, the last. Rows with equal keys are
    taken by doc_id, then size; repeated rows count each. An empty table gives an empty result.
    """
    sized = word_sizes(docs)
    if quality is not None:
        votes = quality.where("doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
        sized = sized.join(votes, "doc_id", "left")
    else:
        sized = sized.withColumn("quality", F.lit(None).cast("double"))
    weight = 1.0 + 3.0 * F.least(F.greatest(F.coalesce("quality", F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    sized = stage(sized.select("doc_id", "source", "size", exponential_key(weight, seed).alias("key")), "mix-sizes")
    # with weights of 1 or more, exp(-key) has a density of at most the largest weight: equal ranges of it hold few rows
    keyed = sized.withColumns({"name": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), "range": F.floor((1 - F.exp(-F.col("key"))) * RANGES).cast("int")})
    ranges = stage(keyed.groupBy("name", "range").agg(F.first("source").alias("source"), F.sum("size").alias("bytes")), "mix-ranges")
    targets = source_targets(ranges.groupBy("name").agg(F.first("source").alias("source"), F.sum("bytes").alias("source_size")).drop("name"), weights, share, most)
    targets = targets.withColumn("name", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")
    before = Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.select("name", "range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base")).join(targets, "name")
    own = Window.partitionBy("name", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0))).join(bases, ["name", "range"])
    budget, total = F.floor(F.col("target") + 0.5).cast("long"), F.greatest(F.col("source_size"), F.lit(1))
    placed = placed.withColumns({"epochs": F.floor(budget / total).cast("long"), "before": F.col("base") + F.col("own")})
    rest = budget - F.col("epochs") * total
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return placed.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time that a document is taken.

    Documents stay whole: the one at which a source's budget ends is taken if half of its words or more are, so a source
    misses its target by half a document at most. Rows without doc_id stay as they are and are no part of the budget;
    rows that repeat an id and a number of words are each taken as often as the one of them that is taken most. Null and
    empty texts have no words and go. An empty table gives an empty result.
    """
    size, times = (name + "_" * sum(c.startswith(name) for c in docs.columns) for name in ("__size", "__times"))

    def add_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(word_counts(batch.column("text")))], [*batch.schema.names, size])

    known = docs.where(F.col("doc_id").isNotNull())
    whole = F.floor(F.max("taken") / F.col("size") + 0.5).cast("int")
    taken = mix_sources(known, quality).where("size > 0").groupBy("doc_id", "size").agg(whole.alias(times)).where(F.col(times) > 0).withColumnRenamed("size", size)
    sized = known.mapInArrow(add_size, StructType([*docs.schema.fields, StructField(size, LongType())]))
    copies = sized.join(taken, ["doc_id", size]).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
    return copies.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


ORACLE = r"""
WITH votes AS (SELECT doc_id, avg(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
sized AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null' || md5(coalesce(d.text, ''))) || ':17'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / (1.0 + 3.0 * least(greatest(coalesce(v.quality, 0.5), 0.0), 1.0)) AS key
  FROM documents d LEFT JOIN votes v USING (doc_id)),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, 2.0 * source_size AS lim, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
    row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM sums),
levels AS (
  SELECT *, (1.5 * (SELECT sum(source_size) FROM sums)::DOUBLE
      - coalesce(sum(lim::DOUBLE) OVER (ORDER BY lim / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY lim / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
targets AS (
  SELECT source, source_size, least((SELECT level FROM levels WHERE level <= lim / weight ORDER BY lim / weight, rnk LIMIT 1) * weight, lim)::DOUBLE AS target
  FROM levels),
placed AS (
  SELECT s.*, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target, budget // greatest(source_size, 1) AS epochs,
  (budget // greatest(source_size, 1) * size + greatest(0, least(size, budget % greatest(source_size, 1) - before)))::BIGINT AS taken
FROM placed
"""
