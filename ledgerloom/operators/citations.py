"""Figures printed in reports against the numbers and days that evidence has, within half a unit of the last digit."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.checkpoints import cut

# What a unit multiplies by, units that are also read as one another, months, the mark of hidden text.
UNITS = {"lakh": 10**5, "crore": 10**7, "cr": 10**7, "k": 10**3, "m": 10**6, "bn": 10**9, "thousand": 10**3, "million": 10**6, "billion": 10**9}
INDIAN = ("lakh", "crore", "cr")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
REDACTED = "[REDACTED]"
EVERYWHERE = "all"
#: Numbers have at most so many digits before and after the point; others match nothing.
NUMBER, EXACT = "decimal(25,8)", "decimal(38,10)"
AROUND = 24
#: Tasks that read the texts.
SPREAD = 96

# A text is read as tokens from left to right. What is glued to a word or to a number belongs to that token, so that
# digits inside it are never read by themselves; a sign or currency after it joins two tokens and isn't the next one's.
_W = r"[\p{L}\p{N}_]"
_GLUED = r"[\p{L}\p{N}_.]*+(?:(?<=[\p{L}\p{N}_.])[-+−₹$])?"
_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
_DAY_MONTH = rf"[0-9]{{1,2}} (?i:{'|'.join(MONTHS)})[a-z]* [0-9]{{4}}(?!{_W})"
_ITEM = r"(?m:^)[ \t]*(?:[-*][ \t]+)?[0-9]{1,3}[.)]\s"
_LEAD = r"(?:[-+−]|(?:[₹$]|USD|INR)[-+−]?)?"
_DIGITS = r"(?:[0-9]{1,3}(?:,[0-9]{2,3})+|[0-9]+)(?:\.[0-9]+)?"
_NAMED = rf"(?:\s?(?:x|{'|'.join(UNITS)})(?![A-Za-z]))?"
_PARTS = rf"^({_LEAD})({_DIGITS})(?:(\s?%)|({_NAMED})({_GLUED}))$"
TOKEN = "|".join([_ITEM, _DAY_MONTH, rf"{_DATE}[\p{{L}}\p{{N}}_-]*+", rf"{_LEAD}{_DIGITS}(?:\s?%|{_NAMED}{_GLUED})", rf"{_W}{_GLUED}", rf"\.{_GLUED}"])

_FIGURE = "struct<text:string,value:decimal(25,8),decimals:int,unit:string,day:date>"


def _day(token: Column) -> Column:
    words = F.split(token, " ")
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(F.get(words, F.lit(1)), 1, 3)))
    spelled = F.concat_ws("-", F.get(words, F.lit(2)), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.get(words, F.lit(0)), 2, "0"))
    # both forms have four digits first; a day that doesn't exist gives null
    return F.try_to_date(F.when(token.contains(" "), spelled).otherwise(token), "yyyy-MM-dd")


def _number(token: Column) -> Column:
    """The figure of a token that begins like a number, or null if letters follow its digits."""
    lead, digits = F.regexp_extract(token, _PARTS, 1), F.regexp_extract(token, _PARTS, 2)
    unit, glued = F.concat(F.regexp_extract(token, _PARTS, 3), F.regexp_extract(token, _PARTS, 4)), F.regexp_extract(token, _PARTS, 5)
    value = F.replace(digits, F.lit(","), F.lit("")).try_cast(NUMBER)
    whole = F.struct(
        F.concat(lead, digits, unit).alias("text"), F.when(lead.rlike("[-−]"), -value).otherwise(value).cast(NUMBER).alias("value"),
        F.length(F.regexp_extract(digits, r"\.([0-9]+)$", 1)).alias("decimals"), F.ltrim(F.regexp_replace(unit, r"\s", "")).alias("unit"), F.lit(None).cast("date").alias("day"),
    )
    return F.when((digits != "") & ((unit != "") | ~glued.rlike(r"^\p{L}")), whole)


def _read(token: Column) -> Column:
    """The figures of one token: none, one, or those of the parts of what looks like a date and isn't."""
    dated = token.rlike(rf"^(?:{_DATE}|{_DAY_MONTH})$")
    one = F.struct(token.alias("text"), F.lit(None).cast(NUMBER).alias("value"), F.lit(0).alias("decimals"), F.lit("").alias("unit"), _day(token).alias("day"))
    looks = token.rlike(rf"^{_DATE}") | dated
    parts = F.transform(F.filter(F.regexp_extract_all(token, F.lit(rf"{_W}+"), 0), lambda p: p.rlike("^[0-9]")), _number)
    number = token.rlike(rf"^{_LEAD}[0-9]") & ~token.rlike(r"[.)]\s$")
    found = F.when(dated & _day(token).isNotNull(), F.array(one)).when(looks, parts).when(number, F.array(_number(token))).otherwise(F.array().cast(f"array<{_FIGURE}>"))
    return F.filter(found, lambda f: f.isNotNull())


def figures(blocks: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``blocks`` but the text, with n (the token's place), figure, value, decimals, unit, day and context.

    A figure is a number with grouping commas, decimals, a sign, a currency before and a unit after it, or a date
    (2026-01-02, 2 Jan 2026). Left out: numbers glued to letters, and those that number a line. Of a date that doesn't
    exist its parts are numbers. Null and empty texts have none. Numbers with more digits than ``NUMBER`` have no value.
    """
    words = F.regexp_extract_all(F.col(text), F.lit(TOKEN), 0)
    gaps = F.split(F.col(text), TOKEN, -1)
    row = F.struct(*[c for c in blocks.columns if c != text])
    split = blocks.select(row.alias("row"), words.alias("words"), gaps.alias("gaps"))
    # gap, token, gap, ...: a token's neighbourhood is what stands around its place
    pieces = F.flatten(F.transform("gaps", lambda g, i: F.array(g, F.coalesce(F.get("words", i), F.lit("")))))
    laid = split.withColumn("pieces", pieces)
    first = lambda i: F.greatest(F.lit(1), 2 * i + 2 - 2 * AROUND)
    before = lambda i: F.right(F.array_join(F.slice("pieces", first(i), 2 * i + 2 - first(i)), ""), F.lit(AROUND))
    after = lambda i: F.left(F.array_join(F.slice("pieces", 2 * i + 3, F.lit(2 * AROUND)), ""), F.lit(AROUND))
    placed = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("n"), w.alias("word"))), lambda p: p["word"].rlike("[0-9]"))
    tokens = laid.select("row", "pieces", F.explode(placed).alias("p")).select("row", F.col("p.n").alias("n"), F.explode(_read(F.col("p.word"))).alias("f"), before(F.col("p.n")).alias("b"), F.col("p.word").alias("w"), after(F.col("p.n")).alias("a"))
    context = F.trim(F.regexp_replace(F.concat("b", "w", "a"), r"\s+", " "))
    return tokens.select("row.*", "n", F.col("f.text").alias("figure"), "f.value", "f.decimals", "f.unit", "f.day", context.alias("context"))


def evidence_of_text(texts: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``texts`` but the text, with value or day: the numbers and dates of what a tool has said.

    Digits that touch hidden text are no evidence. Numbers have no grouping and no unit here.
    """
    kept = [c for c in texts.columns if c != text]
    mark = F.replace(F.col(text), F.lit(REDACTED), F.lit("\u0001"))
    bare = F.regexp_replace(mark, r"-?[0-9]+(?:\.[0-9]+)?\u0001+|\u0001+-?[0-9]+(?:\.[0-9]+)?", " ")
    days = F.filter(F.regexp_extract_all(F.col(text), F.lit(TOKEN), 0), lambda w: w.rlike(rf"^(?:{_DATE}|{_DAY_MONTH})$"))
    numbers = F.regexp_extract_all(F.regexp_replace(bare, rf"(?<![\p{{L}}\p{{N}}_-]){_DATE}(?![\p{{L}}\p{{N}}_-])", " "), F.lit(rf"-?[0-9]+(?:\.[0-9]+)?{_GLUED}|[\p{{L}}\p{{N}}_.]{_GLUED}"), 0)
    value = F.transform(F.filter(numbers, lambda w: w.rlike("^-?[0-9]")), lambda w: F.struct(F.regexp_extract(w, r"^-?[0-9]+(?:\.[0-9]+)?", 0).try_cast(NUMBER).alias("value"), F.lit(None).cast("date").alias("day")))
    dated = F.transform(days, lambda w: F.struct(F.lit(None).cast(NUMBER).alias("value"), _day(w).alias("day")))
    return texts.select(*kept, F.explode(F.concat(value, dated)).alias("e")).select(*kept, "e.value", "e.day").where("value is not null or day is not null")


def _multipliers(unit: Column) -> Column:
    """The readings of a unit: as written; a percentage as a fraction; the whole amount; lakh and crore as each other."""
    of = {"%": ["1", "0.01"]}
    for name, m in UNITS.items():
        of[name] = ["1", str(m), *([str(Decimal(m) / UNITS[other]) for other in ("lakh", "crore")] if name in INDIAN else [])]
    out = F.array(F.lit("1"))
    for name, readings in of.items():
        out = F.when(unit == name, F.array(*map(F.lit, dict.fromkeys(readings)))).otherwise(out)
    return out


def unmatched(blocks: DataFrame, evidence: DataFrame, registered: DataFrame | None = None, hidden: DataFrame | None = None, most_digits: int = 6) -> DataFrame:
    """run_id, block_id, n, figure, context and reason of each figure that nothing supports.

    ``blocks``: run_id, block_id, scope, text. ``evidence``: run_id, scope (``all`` serves every scope), value, day.
    ``registered``: run_id, value, decimals, unit of numbers that a report may print as they are. ``hidden``: run_id of
    runs of which some evidence was redacted. A figure holds if a reading of its unit is within half a unit of its last
    digit (of the ``most_digits``-th decimal, if it has more) of a number in its scope.

    Half a unit around a figure is what rounds to it: for each number of decimals and each reading, evidence is keyed by
    the whole number that it rounds to, figures by theirs and its neighbours, and equal keys are then compared exactly.
    Of the numbers of one key only the least and the largest are kept: they span less than a unit, which is what a
    figure's bounds are apart, so if any is within them one of the two is. A figure meets three keys at most.

    Evidence and questions grow with the reports, and what files and steps promise of their sizes is far too little. They
    are joined by sorting: a broadcast would gather them in the driver.
    """
    read = blocks.select("run_id", "block_id", F.coalesce("scope", F.lit(EVERYWHERE)).alias("scope"), "text").repartition(SPREAD, "run_id", "block_id")
    found = cut(figures(read))
    places = F.explode(F.array_distinct(F.array("scope", F.lit(EVERYWHERE))))
    numbers = found.where("value is not null").select("run_id", "block_id", "n", "figure", "value", F.least("decimals", F.lit(most_digits)).alias("places"), "unit", places.alias("place"))
    pool = evidence.where("value is not null").select("run_id", F.coalesce("scope", F.lit(EVERYWHERE)).alias("place"), F.col("value").cast(NUMBER).alias("known")).distinct()
    # what many figures of a run ask alike is asked once, and only where there is evidence
    question = ["run_id", "place", "value", "places", "unit"]
    asks = numbers.select(*question).distinct().join(pool.select("run_id", "place").distinct().hint("merge"), ["run_id", "place"], "left_semi")
    asked = asks.withColumn("times", F.explode(_multipliers(F.col("unit"))))
    levels = asked.select("run_id", "place", "places", "times").distinct()
    tens = lambda n: F.pow(F.lit(10.0), n).cast("decimal(10,0)")
    whole = F.floor((F.col("value") * tens(F.col("places"))).cast("decimal(38,4)"))
    asked = asked.withColumn("key", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: (whole + k).cast("decimal(38,0)"))))
    once = lambda c: F.col(c).cast("decimal(12,2)")
    rounded = F.floor((F.col("known") * tens(F.col("places"))).cast("decimal(38,8)") / once("times") + F.lit("0.5").cast("decimal(2,1)")).cast("decimal(38,0)")
    level = ["run_id", "place", "places", "times", "key"]
    pool = pool.join(levels.hint("merge"), ["run_id", "place"]).withColumn("key", rounded).groupBy(*level).agg(F.min("known").alias("least"), F.max("known").alias("most"))
    gap = lambda known: F.abs(F.col(known).cast(EXACT) - (F.col("value") * once("times")).cast(EXACT))
    width = (F.lit("0.5").cast("decimal(2,1)") * once("times") / tens(F.col("places"))).cast(EXACT)
    answered = asked.join(pool.hint("merge"), level).where((gap("least") <= width) | (gap("most") <= width)).select(*question).distinct()
    held = numbers.join(answered.hint("merge"), question).select("run_id", "block_id", "n", "figure")
    dated = found.where("day is not null").withColumn("place", places)
    days = evidence.where("day is not null").select("run_id", F.coalesce("scope", F.lit(EVERYWHERE)).alias("place"), "day").distinct()
    held = held.union(dated.join(days.hint("merge"), ["run_id", "place", "day"]).select("run_id", "block_id", "n", "figure"))
    if registered is not None:
        own = registered.select("run_id", F.abs(F.col("value").cast(NUMBER)).alias("size"), "decimals", "unit").distinct()
        held = held.union(found.withColumn("size", F.abs("value")).join(own.hint("merge"), ["run_id", "size", "decimals", "unit"]).select("run_id", "block_id", "n", "figure"))
    missed = found.join(held.distinct().hint("merge"), ["run_id", "block_id", "n", "figure"], "left_anti")
    reason = F.lit("no evidence in the run")
    if hidden is not None:
        missed = missed.join(hidden.select("run_id", F.lit(True).alias("cut")).distinct(), "run_id", "left")
        reason = F.when(F.col("cut"), "cannot verify: some evidence was redacted").otherwise(reason)
    return missed.select("run_id", "block_id", "n", "figure", "context", reason.alias("reason"))
