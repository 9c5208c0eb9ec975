"""Operator 6, personal data: patterns, and a skip-chain conditional random field that carries their labels on."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.bytewise import slices
from ledgerloom.llm.staging import stage

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
#: Rows with a digit or an @ that the field's potentials are estimated on, at most, and rounds of that.
FIT_ROWS, FIT_ROUNDS = 2000, 2
#: Least marginal probability of an added span, and the change of a message at which passing ends.
SURE, SETTLED = 0.95, 1e-4
#: Rounds of message passing at most: these, and so many for each link of the longest run of linked nodes. Messages are
#: damped by half, so one round carries half of a change over a link.
ROUNDS, LINK_ROUNDS = 64, 4
#: Share of nodes outside base spans that are taken to be personal before anything is known of them, and the most that
#: their form may say for a kind, as a ratio of likelihoods: a form alone is never SURE.
SHARE, FORM_MOST = 0.05, 100.0
#: Pairs with equal and with other labels that are taken as seen beforehand, for each way in which nodes are alike.
SEEN = {"digits": (9999.0, 1.0), "address": (9999.0, 1.0), "network": (9999.0, 1.0), "local": (999.0, 1.0), "chain": (2.0, 2.0)}

#: The log potential of a label other than a given one: so low that no number of messages outweighs it.
_NEVER = -1e9

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARKED = re.compile(r"[0-9@]")
_NUMBER = re.compile(r"\+?[0-9]++(?:[\x20()./-]{1,2}[0-9]++)*+")
_AFTER_AT = re.compile(r"@[A-Za-z0-9-]*+(?:\.[A-Za-z0-9-]++)*+")
_WORD = re.compile(r"[A-Za-z0-9._%+-]{6,}+")
_LONG_RUN = re.compile(r"[0-9]{7,}+")
#: Fewest digits of a number outside base spans that is a node, if it doesn't have the dots of an address.
_DIGITS, _GROUPS = 7, 3

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(values)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns, by kind as listed, then start; each search takes time in proportion to the text."""
    out: list[Span] = []
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append(("email", start, m.end()))
            end = at = m.end()
        else:
            at += 1
    if not _DIGIT.search(text):
        return out
    for m in _DOTTED.finditer(text):
        groups = m[0].split(".")
        start = m.start()
        for k in range(0, len(groups) - 3, 4):
            stop = start + sum(map(len, groups[k : k + 4])) + 3
            if all(len(g.lstrip("0")) <= 3 and int(g[-4:]) <= 255 for g in groups[k : k + 4]):
                out.append(("ip", start, stop))
            start = stop + 1
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


@dataclass
class Nodes:
    """A document's base spans, and what outside them could be personal, in order of the text: the nodes of its field."""

    start: list[int]
    end: list[int]
    text: list[str]
    #: The number of a base span's label, else 0: the label isn't known.
    label: list[int]


def local_part(address: str) -> str:
    """The part before the @ if it is surely no common word, else nothing."""
    local = address.partition("@")[0].casefold()
    return local if len(local) >= 6 and re.search("[0-9._]", local) else ""


def nodes(text: str, base: list[Span]) -> Nodes:
    """Base spans, and between them: texts around an @, numbers of ``_DIGITS`` digits or ``_GROUPS`` dotted groups, and
    words that are the local part of a base address."""
    found = [(a, b, LABELS.index(kind)) for kind, a, b in base]
    locals_ = {local_part(text[a:b]) for kind, a, b in base if kind == "email"} - {""}
    at = 0
    for a, b in [*sorted((a, b) for _, a, b in base), (len(text), len(text))]:
        if a > at:
            _between(text, at, a, locals_, found)
        at = max(at, b)
    found.sort()
    return Nodes([a for a, _, _ in found], [b for _, b, _ in found], [text[a:b] for a, b, _ in found], [x for _, _, x in found])


def _between(text: str, low: int, high: int, locals_: set[str], found: list[tuple[int, int, int]]) -> None:
    taken, at = low, low
    addresses = []
    while (at := text.find("@", at, high)) >= 0:
        start = at
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        taken = at = max(_AFTER_AT.match(text, at, high).end(), at + 1)
        if taken - start >= 5:
            addresses.append((start, taken, 0))
    words = [(m.start(), m.start() + len(m[0].rstrip(".")), 0) for m in _WORD.finditer(text, low, high) if m[0].rstrip(".").casefold() in locals_] if locals_ else []
    numbers = [(m.start(), m.end(), 0) for m in _NUMBER.finditer(text, low, high) if len(m[0]) >= 5 and _is_number(m[0])]
    last = low
    for a, b, label in sorted([*addresses, *words, *numbers], key=lambda x: (x[0], -x[1])):
        if a >= last:
            found.append((a, b, label))
            last = b


def _is_number(text: str) -> bool:
    return len(_DIGIT.findall(text)) >= _DIGITS or (text.count(".") >= _GROUPS - 1 and all(map(str.isdigit, text.split("."))))


def form(text: str) -> str:
    """What a node looks like: an @, or how many digits and dots it has (no kind has more than 19 digits or 4 dots)."""
    if "@" in text:
        return "@" + "." * min(2, text.partition("@")[2].count("."))
    digits = len(_DIGIT.findall(text))
    return f"{min(digits, 20)}" + "." * min(5, text.count(".")) if digits >= _GROUPS else "a"


def keys(text: str) -> set[tuple[str, str]]:
    """In what nodes are alike: the last seven digits, the address up to the dot of its domain, its local part, the
    first three groups of dotted numbers."""
    if "@" in text:
        word = text.casefold()
        local, _, domain = word.partition("@")
        out = {("address", local + "@" + domain.partition(".")[0])} if local and domain else set()
        return out | ({("local", x)} if (x := local_part(word)) else set())
    digits = "".join(_DIGIT.findall(text))
    out = {("digits", g[-_DIGITS:]) for g in [*([digits] if len(digits) >= _DIGITS else []), *_LONG_RUN.findall(text)]}
    groups = text.split(".")
    if len(groups) in (3, 4) and all(map(str.isdigit, groups)):
        out.add(("network", ".".join(groups[:3])))
    return out if digits else {("local", text.casefold())}


@dataclass
class Links:
    """Which nodes share a potential: (node, base node, way) and (node, later node, way) of nodes without base label,
    and pairs of base nodes."""

    given: list[tuple[int, int, str]]
    free: list[tuple[int, int, str]]
    base: list[tuple[int, int, str]]


def links(found: Nodes) -> Links:
    """A node without base label is linked to the nearest base node that is alike, before it or else after it, and to
    the next one without label that is alike; neighbours at most two characters apart are linked, too.

    What a base span says so reaches every occurrence over one link, however many lie between them. Of several ways in
    which two nodes are alike one counts.
    """
    given: dict[tuple[int, int], str] = {}
    free: dict[tuple[int, int], str] = {}
    both: dict[tuple[int, int], str] = {}
    before: dict[tuple[str, str], int] = {}
    known: dict[tuple[str, str], int] = {}
    waiting: dict[tuple[str, str], list[int]] = defaultdict(list)
    for i, text in enumerate(found.text):
        for key in sorted(keys(text)):
            if found.label[i]:
                if key in known:
                    both.setdefault((known[key], i), key[0])
                known[key] = i
                for j in waiting.pop(key, ()):
                    given.setdefault((j, i), key[0])
            else:
                if key in before:
                    free.setdefault((before[key], i), key[0])
                before[key] = i
                if key in known:
                    given.setdefault((i, known[key]), key[0])
                else:
                    waiting[key].append(i)
    for i in range(len(found.text) - 1):
        j = i + 1
        if 0 <= found.start[j] - found.end[i] <= 2:
            if found.label[i] and found.label[j]:
                both.setdefault((i, j), "chain")
            elif found.label[i] or found.label[j]:
                given.setdefault((j, i) if found.label[i] else (i, j), "chain")
            else:
                free.setdefault((i, j), "chain")
    return Links(*(sorted((i, j, way) for (i, j), way in x.items()) for x in (given, free, both)))


def longest_run(pairs: list[tuple[int, int]], number: int) -> int:
    """Edges of the longest path that goes forwards."""
    reach = [0] * number
    for i, j in sorted(pairs):
        reach[j] = max(reach[j], reach[i] + 1)
    return max(reach, default=0)


@dataclass
class Field:
    """Log potentials: of a label by form, and of pairs of labels by the way in which nodes are alike."""

    forms: dict[str, np.ndarray]
    unseen: np.ndarray
    pairs: dict[str, np.ndarray]

    def marginals(self, found: Nodes, linked: Links) -> np.ndarray:
        """Loopy sum-product messages over the links until they settle. Base labels are given, so links to them only
        add to a node's own potential."""
        unary = np.array([self.forms.get(form(t), self.unseen) for t in found.text]).reshape(len(found.text), len(LABELS))
        for i, j, way in linked.given:
            unary[i] += self.pairs[way][:, found.label[j]]
        for i, label in enumerate(found.label):
            if label:
                unary[i] = np.where(np.arange(len(LABELS)) == label, 0.0, _NEVER)
        if not linked.free:
            return _normal(unary)
        edge = np.array([(i, j) for i, j, _ in linked.free])
        potential = np.array([self.pairs[way] for _, _, way in linked.free])
        source, target = np.concatenate((edge[:, 0], edge[:, 1])), np.concatenate((edge[:, 1], edge[:, 0]))
        potential = np.concatenate((potential, potential.transpose(0, 2, 1)))
        back = np.concatenate((np.arange(len(edge)) + len(edge), np.arange(len(edge))))
        message = np.zeros((len(source), len(LABELS)))
        for _ in range(ROUNDS + LINK_ROUNDS * longest_run(edge.tolist(), len(found.text))):
            belief = unary.copy()
            np.add.at(belief, target, message)
            rest = (belief[source] - message[back])[:, :, None] + potential
            top = rest.max(1)
            fresh = top + np.log(np.exp(rest - top[:, None, :]).sum(1))
            fresh -= fresh.max(1, keepdims=True)
            settled = np.abs(fresh - message).max() < SETTLED
            message = 0.5 * message + 0.5 * fresh
            if settled:
                break
        belief = unary.copy()
        np.add.at(belief, target, message)
        return _normal(belief)


def _normal(log_p: np.ndarray) -> np.ndarray:
    p = np.exp(log_p - log_p.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(text: str, base: list[Span], model: Field) -> list[Span]:
    """Nodes outside base spans whose likeliest label is a kind, surely enough. A node without links is never sure."""
    found = nodes(text, base)
    linked = links(found)
    if not linked.given and not linked.free:
        return []
    sure = model.marginals(found, linked)
    best = sure.argmax(1)
    return [(LABELS[k], a, b) for a, b, own, k, p in zip(found.start, found.end, found.label, best, sure.max(1)) if not own and k and p >= SURE]


def _evidence(model: Field | None):
    """Expected counts over texts: of forms by label, and of pairs of base nodes by their labels.

    Base labels are given. What lies outside base spans isn't known: it counts by its marginals under ``model``, or by
    SHARE while there is none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts: Counter = Counter()
            for text in batch.column("text").to_pylist():
                found = nodes(text, base_spans(text))
                linked = links(found)
                belief = model.marginals(found, linked) if model else None
                for i, (t, label) in enumerate(zip(found.text, found.label)):
                    if label:
                        counts["form", form(t), label] += 1.0
                    elif belief is None:
                        counts["form", form(t), 0] += 1 - SHARE
                    else:
                        for k, p in enumerate(belief[i].tolist()):
                            counts["form", form(t), k] += p
                for i, j, way in linked.base:
                    counts["pair", way, int(found.label[i] == found.label[j])] += 1.0
            rows = [(*k, n) for k, n in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 4, (pa.string(), pa.string(), pa.int64(), pa.float64()))], ["what", "name", "label", "n"])

    return run


def field_of(counts: list[tuple[str, str, int, float]]) -> Field:
    """Potentials from expected counts (what, name, label, n). At most as many forms as ``form`` has."""
    forms: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LABELS)))
    pairs = {way: list(seen) for way, seen in SEEN.items()}
    for what, name, label, n in sorted(counts):
        if what == "form":
            forms[name][label] += n
        else:
            pairs[name][1 - label] += n
    smooth = 0.5
    total = sum(forms.values(), np.zeros(len(LABELS))) + smooth * (len(forms) + 1)
    share = np.array([1 - SHARE] + [SHARE / len(KINDS)] * len(KINDS))

    def potential(n: np.ndarray) -> np.ndarray:
        likely = (n + smooth) / total
        return np.log(share) + np.log(np.minimum(likely / likely[0], FORM_MOST))

    table = {}
    for way, (same, other) in pairs.items():
        agree = same / (same + other)
        table[way] = np.log(np.where(np.eye(len(LABELS), dtype=bool), agree, (1 - agree) / len(KINDS)))
    return Field({f: potential(n) for f, n in forms.items()}, potential(np.zeros(len(LABELS))), table)


def fit_field(docs: DataFrame, rows: int = FIT_ROWS, rounds: int = FIT_ROUNDS) -> Field:
    """Potentials estimated by expectation maximisation on at most ``rows`` rows with a digit or an @.

    The sample is bounded by rows: those with the smallest hashes of id and text, repeated rows once. Labels are those
    of base spans; everything outside them is latent.
    """
    marked = docs.where(F.col("text").rlike("[0-9@]")).select(F.xxhash64("doc_id", "text").alias("h"), "text")
    chosen = [(r["h"],) for r in marked.select("h").distinct().orderBy("h").limit(rows).collect()]
    wanted = docs.sparkSession.createDataFrame(chosen, "h long")
    sample = stage(marked.join(F.broadcast(wanted), "h", "left_semi").dropDuplicates(["h"]).select("text"), "field-sample")
    model = None
    for _ in range(rounds + 1):
        counts = sample.mapInArrow(_evidence(model), "what string, name string, label long, n double").groupBy("what", "name", "label").agg(F.sum("n").alias("n")).collect()
        # sums of floats depend on their order
        model = field_of([(r["what"], r["name"], r["label"], round(r["n"], 6)) for r in counts])
    return model


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def _find(model: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns: list[list] = [[] for _ in range(6)]
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                number = Counter(kind for kind, _, _ in base)
                extra = added_spans(text, base, model) if _MARKED.search(text) else []
                for column, value in zip(columns, (*(number[k] for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + extra))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:]]], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return run


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, numbers of base spans by kind, base_sha256, and all spans (base ones and those that the field adds).

    The field's nodes are base spans, whose labels are given, and numbers, addresses and local parts outside them, whose
    labels are not. A node that is alike a base span of its document shares a potential with it, and becomes a span of
    that kind if its marginal reaches ``SURE``: the same number or address in another form, or a part of it. Spans that
    only look personal stay out. Null and empty texts have no spans. Repeated rows are each searched. An empty table
    gives an empty result. Other columns of ``docs`` are ignored.
    """
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(_find(fit_field(docs)), f"doc_id long, {counts}, base_sha256 string, spans string")


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, with personal data in ``text`` replaced and ``n_chars`` set anew.

    Null and empty texts stay as they are, ``n_chars`` of a null text is null. Repeated rows are each redacted alike. An
    empty table gives an empty result. ``docs`` has doc_id, text and n_chars; other columns stay.
    """
    model = fit_field(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for text in batch.column("text"):
                text = text.as_py()
                base = base_spans(text) if text else []
                spans = base + added_spans(text, base, model) if text and _MARKED.search(text) else []
                texts.append(redact(text, spans) if spans else text)
            fresh = {"text": texts, "n_chars": [None if t is None else len(t) for t in texts]}
            yield pa.RecordBatch.from_arrays([pa.array(fresh[n], batch.schema.field(n).type) if n in fresh else batch.column(n) for n in batch.schema.names], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
