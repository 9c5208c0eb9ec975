"""Readers of market files. Each returns rows; rows that can't be used carry a reason or are counted by the caller."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equity series of the first exchange, and what stands for a missing number.
EQUITY_SERIES = ("EQ", "BE", "BZ", "SM", "ST")
MISSING = ("", "-", ".", "NA", "N.A.")

#: Column names of broker exports for the template's columns.
PRESETS: dict[str, dict[str, tuple[str, ...]]] = {
    "zerodha": {"symbol": ("instrument", "symbol"), "isin": ("isin",), "quantity": ("qty.", "quantity available", "quantity"), "avg_cost": ("avg. cost", "average price")},
    "groww": {"isin": ("isin",), "quantity": ("quantity",), "avg_cost": ("average buy price", "average price")},
    "upstox": {"symbol": ("symbol", "trading symbol"), "isin": ("isin",), "quantity": ("quantity", "qty"), "avg_cost": ("avg price", "average price", "avg. price")},
}


def number(text: Column, scale: int = 6) -> Column:
    """A decimal from text with thousands commas; null for what stands for a missing number and for anything else."""
    bare = F.upper(F.trim(text))
    return F.when(bare.isin(*MISSING), None).otherwise(F.regexp_replace(bare, ",", "").try_cast(f"decimal(28,{scale})"))


def day(text: Column, pattern: str) -> Column:
    return F.to_date(F.try_to_timestamp(text, F.lit(pattern)))


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


def bhavcopy(spark: SparkSession, path: str, series: Sequence[str] | None = EQUITY_SERIES) -> DataFrame:
    """date, isin, symbol, series, open, high, low, close, volume, fault; ``series`` None takes every series."""
    raw = _csv(spark, path)
    if series is not None:
        raw = raw.where(F.col("SctySrs").isin(*series))
    bars = raw.select(
        day(F.col("TradDt"), "yyyy-MM-dd").alias("date"), F.col("ISIN").alias("isin"), F.col("TckrSymb").alias("symbol"), F.col("SctySrs").alias("series"),
        *[number(F.col(a)).alias(b) for a, b in (("OpnPric", "open"), ("HghPric", "high"), ("LwPric", "low"), ("ClsPric", "close"))], F.col("TtlTradgVol").try_cast("bigint").alias("volume"),
    )
    return bars.withColumn("fault", _fault())


def _fault() -> Column:
    inside = lambda c: F.col(c).between(F.col("low"), F.col("high"))
    negative = F.least("open", "high", "low", "close") < 0
    return F.when(F.col("date").isNull() | F.col("close").isNull(), "missing").when(negative, "negative").when(F.col("high") < F.col("low"), "high below low").when(~inside("open"), "open outside").when(~inside("close"), "close outside")


def index_closes(spark: SparkSession, path: str) -> DataFrame:
    """name (capitals), date, open, high, low, close, volume of an index file."""
    values = [number(F.col(f"`{a} Index Value`")).alias(b) for a, b in (("Open", "open"), ("High", "high"), ("Low", "low"), ("Closing", "close"))]
    return _csv(spark, path).select(F.upper("`Index Name`").alias("name"), day(F.col("`Index Date`"), "dd-MM-yyyy").alias("date"), *values, number(F.col("Volume"), 0).cast("bigint").alias("volume"))


def daily_csv(spark: SparkSession, path: str) -> DataFrame:
    """Date, Open, High, Low, Close, Volume as bars of a source that is adjusted for splits already."""
    values = [number(F.col(c)).alias(c.lower()) for c in ("Open", "High", "Low", "Close")]
    return _csv(spark, path).select(day(F.col("Date"), "yyyy-MM-dd").alias("date"), *values, F.col("Volume").try_cast("bigint").alias("volume"))


def corporate_actions(spark: SparkSession, path: str) -> DataFrame:
    """symbol, ex_date, kind, ratio, amount from free text: bonus, then split, then dividend; others and undated rows go."""
    rows = spark.read.schema("symbol string, subject string, exDate string").option("multiLine", True).json(path)
    said = F.regexp_replace(F.lower(F.col("subject")), "\\s+", " ")
    # a bonus names two whole numbers with a colon after the word; a split says from one face value to another; a
    # dividend is followed by an amount. Amounts stand after rs, re or rs. within the part of the text that they belong to
    amount = r"r[se]\.? ?([0-9]+(?:\.[0-9]+)?)"
    tail = lambda word: F.substring_index(said, word, -1)
    bonus, source, goal, paid = F.regexp_extract_all(tail("bonus"), F.lit("([0-9]+)")), F.regexp_extract(F.substring_index(tail("from "), " to ", 1), amount, 1), F.regexp_extract(tail(" to "), amount, 1), F.regexp_extract(tail("dividend"), amount, 1)
    is_bonus = F.contains(said, F.lit("bonus")) & tail("bonus").rlike("^ *[0-9]+ *: *[0-9]+")
    is_split = F.contains(said, F.lit("from ")) & (source != "") & (goal != "")
    is_paid = F.contains(said, F.lit("dividend")) & (paid != "")
    kind = F.when(is_bonus, "bonus").when(is_split, "split").when(is_paid, "dividend")
    number_ = lambda c: c.try_cast("decimal(18,8)")
    ratio = F.when(is_bonus, number_(F.get(bonus, F.lit(0))) / F.nullif(number_(F.get(bonus, F.lit(1))), F.lit(0))).when(is_split, number_(source) / F.nullif(number_(goal), F.lit(0)))
    found = rows.withColumns({"ex_date": day(F.col("exDate"), "dd-MMM-yyyy"), "kind": kind, "ratio": ratio, "paid": number_(paid)}).where("kind is not null and ex_date is not null")
    return found.select("symbol", "ex_date", "kind", F.col("ratio").cast("decimal(18,8)").alias("ratio"), F.when(F.col("kind") == "dividend", F.col("paid")).alias("amount"))


def nav_text(spark: SparkSession, path: str) -> DataFrame:
    """scheme, name, nav, date, fault from ``;``-separated lines; header, category and house lines are skipped."""
    parts = spark.read.text(path).where(F.col("value").contains(";") & ~F.col("value").startswith("Scheme Code")).select(F.transform(F.split("value", ";"), F.trim).alias("p"))
    at = lambda k: F.get("p", F.lit(k))
    rows = parts.select(at(0).alias("scheme"), at(3).alias("name"), number(at(4), 4).alias("nav"), day(at(5), "dd-MMM-yyyy").alias("date"), F.upper(at(4)).isin(*MISSING).alias("none"), F.size("p").alias("n"))
    fault = F.when((F.col("n") < 6) | ~F.col("scheme").rlike("^[0-9]+$"), "malformed").when(F.col("none"), "no value").when(F.col("date").isNull(), "no date").when(F.coalesce(F.col("nav") <= 0, F.lit(True)), "not positive")
    return rows.select("scheme", "name", "nav", "date", fault.alias("fault"))


def nav_history(spark: SparkSession, path: str) -> DataFrame:
    """scheme, date, nav of a fund's JSON history; only positive values."""
    raw = spark.read.schema("meta struct<scheme_code: string>, data array<struct<date: string, nav: string>>").option("multiLine", True).json(path)
    points = raw.select(F.col("meta.scheme_code").alias("scheme"), F.inline("data"))
    return points.select("scheme", day(F.col("date"), "dd-MM-yyyy").alias("date"), number(F.col("nav"), 4).alias("nav")).where("nav > 0 and date is not null")


def fund_holdings(spark: SparkSession, path: str) -> DataFrame:
    """scheme, month_end, isin, name, weight_pct, asset_type: one row per month and holding."""
    held = "array<struct<isin: string, name: string, weight_pct: string, asset_type: string>>"
    raw = spark.read.schema(f"amfi_code string, months array<struct<month_end: string, holdings: {held}>>").option("multiLine", True).json(path)
    months = raw.select(F.col("amfi_code").alias("scheme"), F.inline("months"))
    return months.select("scheme", day(F.col("month_end"), "yyyy-MM-dd").alias("month_end"), F.inline("holdings")).withColumn("weight_pct", number(F.col("weight_pct"), 4).cast("decimal(9,4)"))


def observations(spark: SparkSession, path: str) -> DataFrame:
    """date and value of a macro series; a missing value stays as null."""
    raw = spark.read.schema("observations array<struct<date: string, value: string>>").option("multiLine", True).json(path)
    return raw.select(F.inline("observations")).select(day(F.col("date"), "yyyy-MM-dd").alias("date"), number(F.col("value"), 8).alias("value"))


def company_facts(spark: SparkSession, path: str) -> DataFrame:
    """taxonomy, concept, unit, start, end, value, filed, form; facts without end, value or filing day go."""
    fact = "array<struct<start: string, end: string, val: decimal(28,4), filed: string, form: string>>"
    raw = spark.read.schema(f"facts map<string, map<string, struct<units: map<string, {fact}>>>>").option("multiLine", True).json(path)
    concepts = raw.select(F.explode("facts").alias("taxonomy", "c")).select("taxonomy", F.explode("c").alias("concept", "u")).select("taxonomy", "concept", F.explode("u.units").alias("unit", "f"))
    facts = concepts.select("taxonomy", "concept", "unit", F.inline("f"))
    return facts.select("taxonomy", "concept", "unit", *[day(F.col(c), "yyyy-MM-dd").alias(c) for c in ("start", "end", "filed")], F.col("val").alias("value"), "form").where("`end` is not null and value is not null and filed is not null")


def chart(spark: SparkSession, path: str) -> DataFrame:
    """date, open, high, low, close, volume from parallel arrays; the day is that of the exchange; null closes go."""
    quote = "array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<bigint>>>"
    raw = spark.read.schema(f"chart struct<result: array<struct<meta: struct<gmtoffset: bigint>, timestamp: array<bigint>, indicators: struct<quote: {quote}>>>>").option("multiLine", True).json(path)
    one = raw.select(F.explode("chart.result").alias("r")).select("r.meta.gmtoffset", "r.timestamp", F.col("r.indicators.quote")[0].alias("q"))
    names = ("open", "high", "low", "close", "volume")
    rows = one.select("gmtoffset", F.inline(F.arrays_zip("timestamp", *[F.col(f"q.{n}").alias(n) for n in names])))
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.floor((F.col("timestamp") + F.col("gmtoffset")) / 86400).cast("int"))
    return rows.where("close is not null").select(date.alias("date"), *[F.col(n).cast("decimal(18,6)").alias(n) for n in names[:4]], "volume")


def holdings_csv(spark: SparkSession, path: str, preset: str | None = None, label: str | None = None) -> DataFrame:
    """account_label, isin, symbol, quantity, avg_cost, currency, asset_class, error for the template or a broker's export.

    Rows with quantity 0 go. The caller stores a file only if no row has an error.
    """
    raw = _csv(spark, path)
    by_name = {c.strip().lower(): c for c in raw.columns}
    fields = ("account_label", "isin", "symbol", "exchange", "quantity", "avg_cost", "currency", "asset_class")
    names: Mapping[str, tuple[str, ...]] = PRESETS[preset] if preset else {f: (f,) for f in fields}

    def cell(field: str) -> Column:
        there = next((by_name[n] for n in names.get(field, ()) if n in by_name), None)
        return F.coalesce(F.trim(F.col(f"`{there}`")), F.lit("")) if there else F.lit("")

    rows = raw.select(*[cell(f).alias(f) for f in fields])
    if label is not None:
        rows = rows.withColumn("account_label", F.lit(label))
    rows = rows.withColumns({"isin": F.upper("isin"), "currency": F.upper(F.when(F.col("currency") == "", "INR").otherwise(F.col("currency"))), "asset_class": F.lower(F.when(F.col("asset_class") == "", "equity").otherwise(F.col("asset_class"))), "q": number(F.col("quantity")), "c": number(F.col("avg_cost"))})
    own_amount = F.col("asset_class").isin("cash", "fd")
    error = (
        F.when(F.col("account_label") == "", "account_label is empty").when((F.col("isin") == "") & (F.col("symbol") == ""), "needs an isin or a symbol")
        .when((F.col("isin") != "") & ~F.col("isin").rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$"), "isin is not valid").when(F.col("currency") != "INR", "currency is not supported")
        .when(F.col("q").isNull(), "quantity is not a number").when(F.col("q") < 0, "quantity is negative").when((F.col("avg_cost") == "") & ~own_amount, "avg_cost is required")
        .when((F.col("avg_cost") != "") & F.col("c").isNull(), "avg_cost is not a number").when(F.col("c") < 0, "avg_cost is negative")
    )
    return rows.withColumn("error", error).where("error is not null or q <> 0").select("account_label", "isin", "symbol", F.col("q").alias("quantity"), F.col("c").alias("avg_cost"), "currency", "asset_class", "error")
