"""Operator 8, quality rules: text statistics and a learned decision list, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.staging import stage

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Thresholds that rules may use. Their product bounds the table of counts from which rules are learned.
GRID: dict[str, tuple[float, ...]] = {
    "n_words": (10, 20, 50, 100, 200, 500, 1000, 5000, 20000),
    "word_length": (2, 3, 4, 5, 6, 7, 8, 10, 12, 20),
    "symbol_rate": (0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1, 2),
    "dup_line_rate": (0.01, 0.05, 0.1, 0.2, 0.3, 0.5),
    "repeat_rate": (0.01, 0.02, 0.05, 0.1, 0.2, 0.5),
}


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _repeat_words(hashes: Column) -> Column:
    """Words inside a window of five that occurs at least twice, from the windows' hashes in order."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<int>")
    pairs = F.zip_with(placed, F.slice(placed, 2, F.size(placed)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(none))
    start = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(F.sort_array(F.array_distinct(F.flatten(pairs))), start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(5), p - a["last"])).alias("n")), lambda a: a["n"])


def text_statistics(docs: DataFrame) -> DataFrame:
    """Per row: n_words, word_chars, n_symbols, n_lines (lines with a word), n_dup_lines, n_repeat_words (all long).

    A null or empty text has zeros. Windows of five words are compared by a 64-bit hash of their words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: _without(line, SPACES) != "").alias("lines"),
        F.length(_without(F.col("text"), SPACES)).alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).alias("n_symbols"),
    )
    window = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(5)])
    hashed = split.select(
        "doc_id",
        F.size("words").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.size("words") >= 6, F.transform(F.sequence(F.lit(0), F.size("words") - 5), window)).alias("hashes"),
    )
    repeats = F.when(F.size("hashes") > F.size(F.array_distinct("hashes")), _repeat_words(F.col("hashes"))).otherwise(0)
    return hashed.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")], F.coalesce(repeats, F.lit(0)).cast("long").alias("n_repeat_words"))


def features() -> dict[str, Column]:
    """What rules test, from the columns of ``text_statistics``."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbol_rate": F.col("n_symbols") / words,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_rate": F.col("n_repeat_words") / words,
    }


@dataclass(frozen=True)
class Test:
    """``feature >= threshold`` if above, else ``feature < threshold``."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value >= self.threshold if self.above else value < self.threshold

    def holds(self, cell: dict) -> bool:
        """For a cell of counts: its bin of a feature is the number of grid thresholds at or below the value."""
        reached = cell[self.feature] > GRID[self.feature].index(self.threshold)
        return reached == self.above


TESTS = [Test(f, above, t) for f, grid in GRID.items() for t in grid for above in (True, False)]


def labelled_counts(stats: DataFrame, labels: DataFrame) -> list[dict]:
    """Counts of labelled documents by the bins of their features; the grid bounds their number at any input size."""
    bins = {f: sum((F.when(features()[f] >= t, 1).otherwise(0) for t in grid), F.lit(0)) for f, grid in GRID.items()}
    votes = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = stats.join(votes, "doc_id").select(*[b.alias(f) for f, b in bins.items()], (F.col("quality") < 0.5).alias("bad"), held.alias("prune"))
    return [r.asDict() for r in rows.groupBy(*GRID, "bad", "prune").agg(F.count("*").alias("n")).collect()]


def learn_rules(cells: list[dict], precision: float = 0.95, least: int = 5, most_tests: int = 4, most_rules: int = 16) -> list[tuple[Test, ...]]:
    """Sequential covering: grow a conjunction on two thirds of the labelled rows, prune it on the rest, drop what it covers.

    A rule is kept if it covers at least ``least`` rows and at least ``precision`` of the covered rows of both parts
    together are bad; learning stops at the first rule that isn't.
    """
    weigh = lambda part, bad: sum(c["n"] for c in part if c["bad"] == bad)
    cover = lambda part, rule: [c for c in part if all(t.holds(c) for t in rule)]
    share = lambda part: weigh(part, True) / max(1, weigh(part, True) + weigh(part, False))
    rules: list[tuple[Test, ...]] = []
    while len(rules) < most_rules:
        grow, prune = [c for c in cells if not c["prune"]], [c for c in cells if c["prune"]]
        rule: tuple[Test, ...] = ()
        part = grow
        while len(rule) < most_tests and weigh(part, False):
            best = max(TESTS, key=lambda t: (_gain(part, cover(part, (t,)), weigh, share), -TESTS.index(t)))
            inner = cover(part, (best,))
            if _gain(part, inner, weigh, share) <= 0:
                break
            rule, part = (*rule, best), inner
        worth = lambda r: ((weigh(x := cover(prune, r), True) - weigh(x, False)) / max(1, weigh(x, True) + weigh(x, False)), weigh(x, True))
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        covered = cover(cells, rule)
        if not rule or weigh(covered, True) < least or share(covered) < precision:
            break
        rules.append(rule)
        cells = [c for c in cells if not all(t.holds(c) for t in rule)]
    return rules


def _gain(part, inner, weigh, share) -> float:
    """FOIL's information gain: bad rows kept, times the rise of the logarithm of their share."""
    kept = weigh(inner, True)
    return kept * (log2(share(inner)) - log2(share(part))) if kept else 0.0


def rules_column(rules: list[tuple[Test, ...]]) -> Column:
    """The decision list as one conditional expression: 0 where no rule holds, else the number of the first that does."""
    out = None
    for n, rule in enumerate(rules, 1):
        condition = rule[0].column()
        for test in rule[1:]:
            condition = condition & test.column()
        out = F.when(condition, n) if out is None else out.when(condition, n)
    return F.lit(0) if out is None else out.otherwise(0)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of every row of ``docs`` and the verdict of base limits, then of rules learned from ``labels``.

    Null and empty texts have zeros and fail the base limits. Labels may be missing, null or repeated (averaged); without
    any, only the base limits decide. Repeated rows are judged alike. Other columns of ``docs`` are ignored.
    """
    stats = stage(text_statistics(docs), "quality-statistics")
    rule = rules_column(learn_rules(labelled_counts(stats, labels)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (rule == 0)).alias("kept"), F.when(failed, 0).otherwise(rule).cast("int").alias("rule"))
