import numpy as np
import pyarrow as pa
from llm_cases import as_rows, empty, frame
from pyspark.sql import functions as F

from cardflow.llm import langid

SMALL = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SMALL)
    found = langid.identify_held_out(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    right = [r["lang"] == r["lang_pred"] for r in found]
    assert len(right) > 150 and sum(right) / len(right) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_corrected_counts_are_near_the_exact_ones(spark):
    docs = spark.read.parquet(SMALL)
    model = langid.learn(docs, F.lit(True))
    found = langid.language_grams(docs.filter("lang IS NOT NULL")).toPandas()
    held = {lang: set(own["gram"]) for lang, own in found.groupby("lang")}
    texts = pa.array([r["text"] for r in docs.limit(50).collect()])
    got = langid.shares(texts, model)
    packed, starts = langid.grams(texts)
    ends = [*starts[1:].tolist(), len(packed)]
    for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
        own = [int(g) for g in packed[a:b] if g != langid.BLANK]
        exact = [sum(g in held[lang] for g in own) / max(1, len(own)) for lang in model.languages]
        assert np.abs(got[i] - exact).max() < 0.06


def test_every_gram_of_the_fitting_rows_is_held(spark):
    docs = spark.read.parquet(SMALL)
    model = langid.learn(docs, F.lit(True))
    for lang, own in langid.language_grams(docs.filter("lang IS NOT NULL")).toPandas().groupby("lang"):
        word, bit = divmod(model.languages.index(lang), 64)
        for slot in langid.slots(own["gram"].to_numpy().astype(np.uint64), model.masks.shape[1]):
            assert (model.masks[word, slot] >> np.uint64(bit) & np.uint64(1)).all()
    assert (model.false_positive < (3 / langid.ROOM) ** langid.HASHES).all()


def test_draw_of_rows_with_one_id_or_none(spark):
    german = [(i, f"der hund und die katze gehen im garten {chr(97 + n % 26)}{n}", "de") for n in range(130) for i in (7, None)]
    english = [(n, f"the dog and the cat walk in the garden {n}", "en") for n in range(130)]
    copies = [(None, "le chien et le chat", "fr")] * 130
    docs = spark.createDataFrame(german + english + copies, "doc_id long, text string, lang string")
    picked, sizes = langid.fitting_rows(docs, 5)
    assert {r["lang"]: r["count"] for r in picked.groupBy("lang").count().collect()} == {"de": 5, "en": 5, "fr": 1}
    assert sizes == {"de": 260, "en": 130, "fr": 130}
    found = langid.identify(docs, langid.learn(docs, F.lit(True), fit_rows=5)).collect()
    assert all(r["lang"] == r["lang_pred"] for r in found)


def test_columns_of_the_same_names_give_way(spark):
    docs = frame(spark).withColumns({"lang_pred": F.lit("x"), "Score": F.lit("y")})
    found = langid.identify(docs, langid.learn(docs, F.lit(True)))
    assert found.columns[-2:] == ["lang_pred", "score"] and len(found.columns) == len(docs.columns)
    assert "x" not in {r["lang_pred"] for r in found.collect()}


def test_grams_do_not_cross_texts():
    texts = ["Ab", None, "", "x" * 7, "é"]
    together, starts = langid.grams(pa.array(texts))
    for text, a, b in zip(texts, starts, [*starts[1:].tolist(), len(together)], strict=True):
        alone, _ = langid.grams(pa.array([text], pa.string()))
        kept = together[a:b]
        assert kept[kept != langid.BLANK].tolist() == alone[alone != langid.BLANK].tolist()


def test_more_than_64_languages(spark):
    names = [f"l{i:03}" for i in range(70)]
    rows = [(i, " ".join(f"{chr(97 + i // 26)}{chr(97 + i % 26)}q{chr(97 + k)}" for k in range(20)), n) for i, n in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify(docs, langid.learn(docs, F.lit(True))).collect()
    assert all(r["lang"] == r["lang_pred"] for r in found)


def test_edges(spark):
    docs = frame(spark)
    found = langid.identify_held_out(docs).collect()
    by_text = langid.identify(docs, langid.learn(docs, F.lit(True))).collect()
    assert len(found) == docs.count()
    for r in by_text:
        lettered = bool(r["text"]) and any(map(str.isalpha, r["text"]))
        assert (r["lang_pred"] in ("en", "de")) == lettered and (lettered or r["score"] == 0)
    unlearned = langid.identify_held_out(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlearned.collect()} == {"und"}
    assert as_rows(langid.identify_held_out(empty(spark)), "doc_id") == []
