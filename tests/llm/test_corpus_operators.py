"""Each operator against a brute-force version, and on rows that are null, empty, repeated, tied or clash in names."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from ledgerloom.llm import language, mixing, nearcopies, neighbours, packing, personal, quality, queries, repeats, sharding, tokencount

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, component long"


def edge_rows():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    base = [" ".join(word() for _ in range(120)) for _ in range(6)]
    near = base[0].split(" ")
    near[60] = "changed"
    texts = [None, "", "   \n", "one", "éé ßß 12", base[0], base[0], " ".join(near), *base[1:], base[1] + "\n" + base[2], "x " * 30_000, base[3] + " " + base[3], "$" * 300, "a.b@c.example call +1 (234) 555-7777 and a.b@c.example", "tab\tand space\x0bend \n\n"]
    rows = [(i, t, "en" if i % 3 else "de", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), 1, "k", 2) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "no id here at all", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def sample(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df, {r["doc_id"]: r["text"] for r in df.collect()}


def test_empty_tables(spark, empty):
    for found in (
        mixing.mix_sources(empty, labels(spark)), nearcopies.near_copies(empty), repeats.remove_repeats(empty), sharding.shard_documents(empty), packing.pack_documents(empty), personal.find_personal_data(empty),
        tokencount.count_tokens(empty), quality.quality_rules(empty, labels(spark)), neighbours.nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")), language.identify_languages(empty),
    ):
        assert found.count() == 0


def test_mixing(spark, docs):
    for df in (docs, sample(spark)[0]):
        found = mixing.mix_sources(df, labels(spark, [(5, 1, 0), (5, 0, 0), (6, None, 0)])).collect()
        assert len(found) == df.count()
        by_source = defaultdict(list)
        for r in found:
            assert 0 <= r["taken"] <= 2 * r["size"]
            by_source[r["source"]].append(r)
        for rows in by_source.values():
            assert sum(r["taken"] for r in rows) == int(np.floor(rows[0]["target"] + 0.5)) or rows[0]["source_size"] == 0
            assert rows[0]["target"] <= 2 * rows[0]["source_size"]
        assert sum(rows[0]["target"] for rows in by_source.values()) == pytest.approx(1.5 * sum(r["size"] for r in found))


def test_mixing_matches_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    wanted = con.execute(queries.ORACLE_SQL["op1_mixing"])
    columns = [c[0] for c in wanted.description]
    found = queries.QUERIES["op1_mixing"](spark, SF).select(columns).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, wanted.fetchall()))


def brute_links(texts):
    sets = {}
    for d, t in texts.items():
        w = WORD.findall(t or "")
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    links, root = Counter(), {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (find(d), links[d]) for d in ids}


def test_near_copies(spark, docs, monkeypatch):
    wanted = brute_links({r[0]: r[1] for r in edge_rows() if r[0] is not None}) | {None: (None, 0)}
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in nearcopies.near_copies(docs).collect()} == wanted
    df, texts = sample(spark)
    monkeypatch.setattr(nearcopies, "BLOCK_SHINGLES", 50)  # many blocks
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in nearcopies.near_copies(df).collect()} == brute_links(texts)


def test_least_matches():
    assert nearcopies.least_matches(32) < nearcopies.least_matches(128) < 0.8 * 128


def brute_repeats(rows):
    count = Counter(b[i : i + 200] for _, b in rows for i in range(len(b) - 199))
    out = []
    for d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("cells", [40_000, 3])
def test_repeats(spark, docs, monkeypatch, cells):
    monkeypatch.setattr(repeats, "CELL_ROWS", cells)
    rows = [(r[0], ("" if r[0] == 14 else r[1] or "").encode()) for r in edge_rows()]
    df = spark.createDataFrame([(d, t.decode()) for d, t in rows], "doc_id long, text string")
    assert sorted((tuple(r) for r in repeats.remove_repeats(df).collect()), key=str) == brute_repeats(rows)


def test_blind_trie():
    rnd = random.Random(1)
    strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 9))) for _ in range(300)]
    order, shared = repeats.BlindTrie(strings).ordered()
    assert [strings[i] for i in order] == sorted(strings)
    assert shared[1:] == [repeats.common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])]


def test_sharding(spark, docs):
    for df in (docs, sample(spark)[0]):
        rows, texts = sharding.shard_documents(df).collect(), df.collect()
        wanted = [(r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in texts]
        assert sorted(map(str, ((r["doc_id"], r["size"], r["text_crc32"]) for r in rows))) == sorted(map(str, wanted))
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(slots) < 24
        shards = defaultdict(set)
        for r in rows:
            shards[r["text_crc32"], r["size"]].add(r["shard"])
        assert all(len(s) == 1 for s in shards.values())


def brute_capacity(sizes, shards):
    def needed(c):
        used, filled = 1, 0
        for s in sizes:
            used, filled = (used + 1, s) if filled + s > c else (used, filled + s)
        return used

    return next(c for c in range(max(sizes), sum(sizes) + 1) if needed(c) <= shards)


@pytest.mark.parametrize("shards", [1, 2, 5, 40])
def test_smallest_capacity(shards):
    rnd = random.Random(shards)
    sizes = [rnd.randint(1, 30) for _ in range(25)]
    before = [0, *itertools.accumulate(sizes)]
    capacity = sharding.smallest_capacity(before, shards)
    assert capacity == brute_capacity(sizes, shards) and sharding.greedy_cuts(before, capacity, shards)[1]


@pytest.mark.parametrize("bits", [1, 3, 16])
def test_shards_are_minimal_over_single_texts(spark, bits):
    """However coarse the first ranges are, the largest shard is the least over groups of equal texts."""
    from pyspark.sql import functions as F

    rnd = random.Random(bits)
    rows = [(i, "x" * rnd.randint(0, 400) + str(rnd.randint(0, 120))) for i in range(300)] + [(i, "hot" * 50) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = df.groupBy(F.xxhash64("text").alias("h")).agg(F.sum(F.octet_length("text") + 8).alias("s")).orderBy("h").collect()
    found = sharding.shard_documents(df, shards=7, bucket_bits=bits).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert max(r["s"] for r in found) == brute_capacity([r["s"] for r in groups], 7)


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df, texts = sample(spark)
    marked = [(-1, "hello <|endoftext|> world"), (-2, "<|endoftext|>"), (-3, "a<|endoftext|><|endoftext|>  b \n<|endoftext"), (-4, "<|endoftext|> " * 3000)]
    df, texts = df.select("doc_id", "text").union(spark.createDataFrame(marked, "doc_id long, text string")), texts | dict(marked)
    found = packing.pack_documents(df).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    tokens = padding = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
        tokens, padding = tokens + at, padding + (0 if at & (at - 1) == 0 else 1024 - at)
    assert padding < 0.02 * tokens
    for d, t in texts.items():
        ids, at = [*own.encode(t or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert packing.pack_documents(docs).groupBy("doc_id").agg({"length": "sum"}).count() == len({r[0] for r in edge_rows()})


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "a \n b\n \nc", "x\n\n y  ", "tab\t end", "don't  stop 123 !!", "  a 　b"])
def test_encoder_cuts_exactly(text):
    import public_tokenizers

    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert encoder.ids(text) == encoder.whole(text)


def test_personal_data(spark, docs):
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def brute(t):
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        out = [("email", *m.span()) for m in email.finditer(t)]
        out += [("ip", *m.span()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [("card", *m.span()) for m in card.finditer(t) if 13 <= len(digits(m)) <= 19 and personal.luhn(digits(m))]
        return out + [("phone", *m.span()) for m in phone.finditer(t) if 9 <= len(digits(m)) <= 15]

    odd = ["a@b@c.d.e @x.y z@-.-", "1.2.3.4.5.6.7.8.9 300.1.1.1.1 01.002.03.4", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 23 +123456789 +(1)", "+12.5.6.7.8 (555) 1-2"]
    texts = [*sample(spark)[1].values(), *odd, *(r[1] or "" for r in edge_rows())]
    for t in texts:
        assert personal.base_spans(t) == brute(t)
    for r, in [(r,) for r in personal.find_personal_data(docs).collect()]:
        assert r["spans"].count("email:") >= r["n_email"]


def test_token_counts(spark, docs):
    import public_tokenizers

    scores = tokencount.unigram_scores(public_tokenizers.path("piece_bpe_32k.model"))
    segmenter = tokencount.Segmenter(scores)

    def brute(word):
        best = [(0.0, 0)] + [None] * len(word)
        for end in range(1, len(word) + 1):
            width = len(word[end - 1].encode())
            options = [(best[s][0] + scores[word[s:end]], best[s][1] - 1) for s in range(end) if word[s:end] in scores]
            if word[end - 1] not in scores:
                options.append((best[end - 1][0] + segmenter.byte * width, best[end - 1][1] - width))
            best[end] = max(options)
        return -best[-1][1]

    found = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in tokencount.count_tokens(docs).collect()}
    for r in edge_rows()[:16]:
        words = WORD.findall(r[1] or "")
        assert found[r[0]] == (len(words), sum(n * brute("▁" + w) for w, n in Counter(words).items()))


def brute_statistics(t):
    words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            inside.update(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)


def test_quality_rules(spark, docs):
    df, texts = sample(spark)
    found = quality.quality_rules(df.unionByName(docs.select(*df.columns)), spark.read.parquet(f"{SF}/labels.parquet")).collect()
    wanted = [(d, *brute_statistics(t or "")) for d, t in [*texts.items(), *((r[0], r[1]) for r in edge_rows())]]
    assert sorted(map(str, (tuple(r)[:6] for r in found))) == sorted(map(str, wanted))
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_rules_are_learned():
    cell = lambda symbols, bad, n, prune: dict.fromkeys(quality.GRID, 0) | {"symbol_rate": symbols, "bad": bad, "prune": prune, "n": n}
    cells = [cell(s, b, n, p) for p in (True, False) for s, b, n in ((6, True, 20), (0, False, 200), (0, True, 3))]
    rules = quality.learn_rules(cells)
    assert len(rules) == 1 and {t.feature for t in rules[0]} == {"symbol_rate"}


def test_neighbours(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(600, 16)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (None, [1.0] * 16)]
    found = neighbours.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    best = defaultdict(list)
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        best[r["query_id"]].append(r["vec_id"])
        assert r["score"] == pytest.approx(float(x[r["query_id"]].astype(float) @ x[r["vec_id"]].astype(float)), abs=1e-9)
    hits = []
    for q in range(0, 600, 20):
        score = x.astype(float) @ x[q].astype(float)
        order = [i for i in np.lexsort((np.arange(600), -score)) if i != q][:20]
        hits.append(len(set(order) & set(best[q])) / 20)
        assert len(best[q]) == 20
    assert np.mean(hits) >= 0.9 and set(best) == set(range(0, 600, 20))


def recall(spark, x, **more):
    """Mean recall at 20 of ``nearest_neighbours`` over rows numbered in order."""
    rows = spark.createDataFrame([(i, [float(v) for v in r], "x") for i, r in enumerate(x)], "vec_id long, embedding array<double>, row string")
    got = defaultdict(list)
    for r in neighbours.nearest_neighbours(rows, **more).collect():
        got[r["query_id"]].append(r["vec_id"])
    hits = []
    for q in range(0, len(x), 20):
        score = x @ x[q]
        score[q] = -np.inf
        top = np.lexsort((np.arange(len(x)), -score))[:20]
        assert len(got[q]) == len(set(got[q])) == 20
        hits.append(len(set(top.tolist()) & set(got[q])) / 20)
    return np.mean(hits)


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_neighbours_recall(spark, monkeypatch, spread):
    """With the shipped settings, with equal and with very unequal lengths, and with files in parts."""
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(4000, 64))
    x *= np.exp(spread * rnd.normal(size=(4000, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(neighbours, "VECTOR_ROWS", 50)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 30)
    assert recall(spark, x) >= 0.9


def test_neighbours_are_exact_if_all_is_visited(spark):
    assert recall(spark, np.random.default_rng(7).normal(size=(300, 8)), visits=256, least=300) == 1.0


def test_neighbours_of_repeated_rows_and_lengths(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 1.0]), (40, [1.0, 2.0, 3.0]), (3, [1.0, 1.0, 1.0])]
    found = neighbours.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    by_query = defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        by_query[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert by_query == {20: [(1, 1, 3.0), (2, 1, 3.0), (3, 2, 2.0)], 40: [(1, 3, 6.0)]}


def test_language(spark, docs):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify_languages(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    own = language.identify_languages(docs).collect()
    assert len(own) == len(edge_rows()) and {r["lang_pred"] for r in own if r["doc_id"] in (0, 1, 2)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in own)


def test_mixed_documents_stay_whole(spark, docs):
    found = Counter(tuple(r) for r in mixing.mixed_documents(docs, labels(spark)).collect())
    rows = {tuple(r) for r in docs.collect()}
    assert set(found) <= rows and found[next(r for r in rows if r[0] is None)] == 1
    taken = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mix_sources(docs.where("doc_id IS NOT NULL"), labels(spark)).collect()}
    for row, n in found.items():
        if row[0] is not None and row[0] != edge_rows()[5][0]:
            size = len(WORD.findall(row[1]))
            assert n == int(taken[row[0], size] / size + 0.5)
    other = spark.createDataFrame([(1, "a b c", "s", 7, 3), (1, "a b c d e", "s", 7, 3), (2, "a", "t", 7, 3)], "doc_id long, text string, source string, __size int, __times int")
    assert {tuple(r) for r in mixing.mixed_documents(other).collect()} <= {tuple(r) for r in other.collect()}


def test_pipeline_stages_on_edge_rows(spark, docs, empty, tmp_path):
    """Each stage on null, empty, repeated and clashing input, and on none."""
    import corpus_pipeline

    labels(spark, [(5, 1, 0)]).write.parquet(f"{tmp_path}/labels.parquet")
    for name, function in corpus_pipeline.STAGES[:4]:
        found = function(spark, docs, str(tmp_path))
        assert found.columns == docs.columns and found.count() >= 0, name
        assert function(spark, empty, str(tmp_path)).count() == 0, name
    assert {r["doc_id"] for r in language.keep_identified(docs).collect()}.isdisjoint({0, 1, 2})
    kept = [r["doc_id"] for r in nearcopies.keep_one_of_each(docs).collect()]
    assert kept.count(None) == 1 and len(kept) == len(set(kept))


def test_pipeline(spark):
    import corpus_pipeline

    df, texts = sample(spark)
    docs, kept = df, {}
    for name, function in corpus_pipeline.STAGES[:4]:
        docs = function(spark, docs, SF).cache()
        kept[name] = docs.collect()
        assert docs.columns == df.columns
    classes = brute_links({r["doc_id"]: r["text"] for r in kept["language_id"]})
    assert {r["doc_id"] for r in kept["ngram_jaccard_join"]} == {d for d, (c, _) in classes.items() if c == d}
    assert not any(personal.base_spans(r["text"]) for r in kept["personal_data"])
    encoder = packing.Encoder(__import__("public_tokenizers").path("byte_bpe_50k.tiktoken"))
    mixed = sum(len(encoder.ids(r["text"])) // 4 + 1 for r in kept["mixing"])
    assert corpus_pipeline.run(spark, SF).selectExpr("sum(length)").first()[0] == mixed


def test_near_copies_with_clashing_columns(spark, docs):
    from pyspark.sql import functions as F

    clash = docs.withColumns({"__turn": F.lit("x"), "turn_": F.lit(1), "class_id": F.lit(2), "set_a": F.lit("y")})
    kept = nearcopies.keep_one_of_each(clash)
    assert kept.columns == clash.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in nearcopies.keep_one_of_each(docs).collect())
