"""Texts in no learned language, and more languages than a fixed number."""

import random

from ledgerloom.llm import language

SF = "/root/testdata/sf0.01"
JUNK = [
    "asdkjh qweoiu zxmcnb lkjhgf poiuyt mnbvcx qazwsx edcrfv tgbyhn ujmikolp wsxzaq",
    '<div class="x1"><span style="color:#fff">&nbsp;</span></div><td>' * 10,
    "Это предложение на другом языке и его следует отбросить",
    "TG9yZW0gaXBzdW0gZG9sb3Igc2l0IGFtZXQsIGNvbnNlY3RldHVy",
]


def test_junk_goes_and_clean_texts_stay(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(-1 - i, t, None, "junk", len(t)) for i, t in enumerate(JUNK)]
    both = df.unionByName(spark.createDataFrame(rows, df.schema))
    kept = {r["doc_id"] for r in language.keep_identified(both).select("doc_id").collect()}
    assert not any(i < 0 for i in kept)
    # texts that the model has never seen
    clean = {r["doc_id"] for r in df.where(language.held_out_rows()).where("length(text) > 40").collect()}
    assert len(clean & kept) >= 0.99 * len(clean)


def test_every_language_is_learned(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(70):
        words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 8))) for _ in range(60)]
        rows += [(100 * k + i, " ".join(rnd.choices(words, k=60)), f"l{k:02}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    wrong = [r for r in language.identify_languages(df).join(df.select("doc_id", "lang"), "doc_id").collect() if r["held_out"] and r["lang"] != r["lang_pred"]]
    assert wrong == []
    kept = {r["doc_id"] for r in language.keep_identified(df).select("doc_id").collect()}
    assert len(kept) >= 0.98 * len(rows)
