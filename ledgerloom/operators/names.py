"""Finding a security by id, symbol or name."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.text import company_name

# Words that don't tell companies apart; least similarity of a candidate; what one needs to be taken.
SUFFIX_WORDS = ("ltd", "limited", "inc", "corp", "corporation", "plc")
LEAST, ACCEPT, GAP = 0.5, 0.92, 0.05


def similarity(a: Column, b: Column) -> Column:
    """Twice the matched characters by all characters, by longest matching blocks; a measure that Spark lacks."""
    @F.pandas_udf("double")
    def measure(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in pairs:
            yield pd.Series([round(SequenceMatcher(None, x or "", y or "").ratio(), 4) for x, y in zip(left, right, strict=True)], dtype=float)

    return measure(a, b)


def lookup(queries: DataFrame, securities: DataFrame, most: int = 5) -> DataFrame:
    """query_id, text, how (id, isin, symbol, name or null), security_id (null unless one is taken), candidates.

    ``queries`` is (query_id, text); ``securities`` (security_id, isin, symbol, name). Text of the form ``id:7``, an
    ISIN or a symbol is taken if one security has it. Else names that have a word of the text, whole or as part
    of a longer one, are scored, only those with every word if there are any, and the best is taken if it is close and
    clear of the next. Different names meet once each: by the rarest word, and by every word only where no name has all of
    them; that work follows how often words occur. Parts are found by equality: of each different word of a name all are
    laid out, which is as many as the square of its length.
    """
    text = F.upper(F.trim("text"))
    keys = {"id": F.concat(F.lit("ID:"), F.col("security_id").cast("string")), "isin": F.upper("isin"), "symbol": F.upper("symbol")}
    keyed = securities.select("security_id", F.inline(F.array(*[F.struct(F.lit(i).alias("order"), F.lit(n).alias("how"), k.alias("key")) for i, (n, k) in enumerate(keys.items())]))).where("key is not null")
    held = keyed.groupBy("key", "order", "how").agg(F.min("security_id").alias("security_id"), F.count_distinct("security_id").alias("n")).where("n = 1")
    exact = queries.withColumn("key", text).join(held, "key").groupBy("query_id").agg(F.min(F.struct("order", "how", "security_id")).alias("e")).select("query_id", "e.how", "e.security_id")
    rest = queries.join(exact, "query_id", "left_anti").select("query_id", company_name(F.col("text"), SUFFIX_WORDS).alias("q"))
    known = securities.select("security_id", company_name(F.coalesce("name", "symbol"), SUFFIX_WORDS).alias("name")).where("name is not null")
    # equal names are met and scored once; of each, the first few securities can be among the best
    turn = F.row_number().over(Window.partitionBy("name").orderBy("security_id"))
    holders = known.select("name", "security_id", turn.alias("turn")).where(F.col("turn") <= most).drop("turn")
    by_word = known.select("name").distinct().select("name", F.explode(F.array_distinct(F.split("name", " "))).alias("has")).where("has <> ''")
    asked = rest.where("q is not null").select("q").distinct().withColumn("words", F.array_distinct(F.split("q", " ")))
    each = asked.select("q", "words", F.explode("words").alias("word")).where("word <> ''")
    sizes = by_word.groupBy("has").agg(F.count("*").alias("often")).withColumn("size", F.explode(F.sequence(F.lit(1), F.length("has"))))
    starts = F.sequence(F.lit(1), F.length("has") - F.col("size") + 1)
    parts = sizes.select("has", "often", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substr("has", i, F.col("size"))))).alias("word"))
    met = parts.join(each.select("word").distinct(), "word")
    often = met.groupBy("word").agg(F.sum("often").alias("often"))
    # a name with every word has the rarest one too, so only names of that are looked at
    rarest = each.join(often, "word").groupBy("q", "words").agg(F.min(F.struct("often", "word"))["word"].alias("word"), F.count("*").alias("n")).where(F.col("n") == F.size("words"))
    every = (F.size(F.array_except("words", F.split("name", " "))) == 0) | F.forall("words", lambda w: F.contains(F.col("name"), w))
    whole = rarest.join(met.select("word", "has"), "word").join(by_word, "has").where(every).select("q", "name").distinct()
    # a score is twice the matched characters by all, so it is bounded by the lengths
    near = 2 * F.least(F.length("q"), F.length("name")) >= (LEAST - 0.0001) * (F.length("q") + F.length("name"))
    partly = each.join(whole.select("q").distinct(), "q", "left_anti").join(met.select("word", "has"), "word").join(by_word, "has").where(near).select("q", "name").distinct()
    scored = whole.where(near).unionByName(partly).withColumn("score", similarity(F.col("q"), F.col("name"))).where(F.col("score") >= LEAST)
    place = Window.partitionBy("q").orderBy(F.desc("score"), "security_id")
    best = scored.join(holders, "name").select("q", "security_id", "score", F.row_number().over(place).alias("place")).where(F.col("place") <= most)
    top = rest.join(best, "q")
    listed = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "security_id", "score"))).alias("candidates"))
    first, second = F.get("candidates", F.lit(0)), F.get("candidates", F.lit(1))
    clear = (first["score"] >= ACCEPT) & (second.isNull() | (F.bround(first["score"] - second["score"], 6) >= GAP))
    named = listed.select("query_id", F.lit("name").alias("how"), F.when(clear, first["security_id"]).alias("security_id"), F.transform("candidates", lambda c: c["security_id"]).alias("candidates"))
    found = exact.withColumn("candidates", F.array("security_id")).unionByName(named)
    return queries.select("query_id", "text").join(found, "query_id", "left")


def tag(items: DataFrame, securities: DataFrame) -> DataFrame:
    """(item_id, title) with the one security that the title names, by a ticker in capitals of three letters or more
    or by a whole normalised name of four characters or more; null for none and for several.

    Tickers and a name's first word meet titles by word; the whole name is then looked for in the title.
    """
    plain = company_name(F.col("title"), ())
    words = items.select("item_id", F.concat(F.lit(" "), plain, F.lit(" ")).alias("plain"), "title")
    tickers = words.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all("title", F.lit("[A-Z0-9&]{3,}"), F.lit(0)))).alias("symbol")).join(securities.select("symbol", "security_id"), "symbol").select("item_id", "security_id")
    named = securities.select("security_id", company_name(F.col("name"), SUFFIX_WORDS).alias("name")).where("length(name) >= 4").withColumn("word", F.split("name", " ")[0])
    by_word = words.withColumn("word", F.explode(F.array_distinct(F.split(F.trim("plain"), " ")))).join(named, "word")
    inside = by_word.where(F.contains("plain", F.concat(F.lit(" "), F.col("name"), F.lit(" ")))).select("item_id", "security_id")
    one = tickers.unionByName(inside).groupBy("item_id").agg(F.min("security_id").alias("security_id"), F.count_distinct("security_id").alias("n")).where("n = 1").drop("n")
    return items.join(one, "item_id", "left")
