"""The field: what it adds, exact marginals by enumeration, and labels that reach every occurrence."""

import hashlib
import itertools

import numpy as np
import pytest

from ledgerloom.llm import personal

COUNTS = [("form", "11", 4, 30.0), ("form", "16", 3, 30.0), ("form", "8...", 2, 30.0), ("form", "@.", 1, 50.0), ("form", "11", 0, 3.0), ("form", "7", 0, 200.0)]
MODEL = personal.field_of(COUNTS)


def added(text, model=MODEL):
    return [(kind, text[a:b]) for kind, a, b in personal.added_spans(text, personal.base_spans(text), model)]


def test_field_adds_repeats_in_other_forms():
    assert added("call +1 (234) 555-7777 or 12345557777 or 555-7777 now") == [("phone", "12345557777"), ("phone", "555-7777")]
    assert added("jo.smith@example.com wrote; JO.SMITH@EXAMPLE said jo.smith is in") == [("email", "JO.SMITH@EXAMPLE"), ("email", "jo.smith")]
    assert added("card 4111 1111 1111 1111 then 4111.1111.1111.1111 or 4111 1111 1111 1112") == [("card", "4111.1111.1111.1111")]
    assert added("host 10.20.30.40 near 10.20.30 and 1.2.3") == [("ip", "10.20.30")]
    assert added("in 2020 there were 1234567 of 4111111111111112, info@ or @home") == []
    assert added("") == added("@@@@@@ .... 1.1.1") == []
    text = "call +1 (234) 555-7777 or 12345557777"
    assert personal.redact(text, personal.base_spans(text) + personal.added_spans(text, personal.base_spans(text), MODEL)) == "call [PHONE] or [PHONE]"
    assert personal.redact("a b", [("ip", 2, 3)]) == "a [IP]"


def enumerated(found, linked, model):
    """Marginals from all labellings of the nodes without base label."""
    free = [i for i, label in enumerate(found.label) if not label]
    out = np.zeros((len(found.text), len(personal.LABELS)))
    for labels in itertools.product(range(len(personal.LABELS)), repeat=len(free)):
        own = list(found.label)
        for i, label in zip(free, labels):
            own[i] = label
        score = sum(model.forms.get(personal.form(found.text[i]), model.unseen)[own[i]] for i in free)
        score += sum(model.pairs[way][own[i], own[j]] for i, j, way in linked.given + linked.free)
        out[np.arange(len(own)), own] += np.exp(score)
    return out / out.sum(1, keepdims=True)


@pytest.mark.parametrize(
    "text",
    ["4111111111111112 x 4111111111111112 x 4111111111111112", "+1 (234) 555-7777 then 234.555.7777, 555-7777; 5557777", "10.20.30.40, 10.20.30, 10.20.30, 300.1.1.1", "a.bc12@x.org a.bc12@x A.BC12 a.bc12@y"],
)
def test_messages_agree_with_enumeration(text):
    found = personal.nodes(text, personal.base_spans(text))
    linked = personal.links(found)
    assert linked.free and MODEL.marginals(found, linked) == pytest.approx(enumerated(found, linked, MODEL), abs=0.02)


@pytest.mark.parametrize("repeats", [1, 8, 50, 300])
def test_label_reaches_all_repeats(repeats):
    before = " ".join(f"dial 234.555.7777 word {'y' * (k % 5)}" for k in range(repeats))
    for text in (f"call +1 (234) 555-7777 now. {before}", f"{before} call +1 (234) 555-7777"):
        assert added(text) == [("phone", "234.555.7777")] * repeats


def test_messages_pass_until_they_settle():
    """Along neighbours alone, a label goes as far as the settled marginals say."""
    n = len(personal.LABELS)
    strong = personal.field_of([("pair", "chain", 1, 1e6)])
    strong = personal.Field({}, np.zeros(n), strong.pairs)
    text = "a@b.example " + ", ".join(str(1234567 + 7 * k) for k in range(60))
    found = personal.nodes(text, personal.base_spans(text))
    assert len(found.text) == 61 and strong.marginals(found, personal.links(found))[-1, 1] > 0.99


def test_fit_and_query(spark):
    rows = [(i, f"call +1 (234) 555-{1000 + i} now, or 1234555{1000 + i} of {i} items" if i % 2 else f"mail jo.{i}@mail.example.com {i}") for i in range(40)]
    rows += [(1, rows[1][1]), (None, "JO.SMITH7@SITE jo.smith7@site.example"), (90, None), (91, ""), (92, "x" * 100_000 + " 1.2.3.4 " + "9" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = personal.fit_field(df)
    found = {r["doc_id"]: r for r in personal.find_personal_data(df).collect()}
    assert len(found) == 44
    for d, t in rows:
        base = personal.base_spans(t or "")
        r = found[d]
        assert [r[f"n_{k}"] for k in personal.KINDS] == [sum(s[0] == k for s in base) for k in personal.KINDS]
        order = sorted(base, key=lambda s: (personal.KINDS.index(s[0]), s[1]))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in order).encode()).hexdigest()
        extra = personal.added_spans(t or "", base, model)
        assert r["spans"] == personal.joined(base + extra)
        if d and d < 40:
            assert len(extra) == d % 2  # the number without plus, and nothing else
    assert "email:0:14" in found[None]["spans"]
    redacted = {r["doc_id"]: r for r in personal.redact_documents(df.selectExpr("doc_id", "text", "length(text) AS n_chars", "1 AS size")).collect()}
    assert redacted[3]["text"] == "call [PHONE] now, or [PHONE] of 3 items" and redacted[3]["n_chars"] == len(redacted[3]["text"])
    assert redacted[90]["text"] is None and redacted[91]["text"] == "" and redacted[3]["size"] == 1


def test_redacting_an_empty_table(spark):
    assert personal.redact_documents(spark.createDataFrame([], "doc_id long, text string, n_chars long")).count() == 0
