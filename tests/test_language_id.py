"""Restricted language identification with a small model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hanstrata.operators import documents, language_id


class Counting:
    """Letters of a few kinds as logits."""

    labels = ["__label__kor_Hang", "__label__eng_Latn", "__label__fra_Latn"]

    def logits(self, text):
        return np.array([sum("가" <= c <= "힣" for c in text), sum(c.isascii() for c in text), sum(c in "éèà" for c in text)], float)


def load():
    return Counting()


def test_scores_before_and_after():
    m = Counting()
    assert language_id.best(m, "가나다") == "kor_Hang" and language_id.best(m, None) == language_id.best(m, " \n") == "UNK"
    before, after = (language_id.among(m, "가나 ab", ("kor_Hang", "fra_Latn"), mode, 2) for mode in ("before", "after"))
    assert before[0][0] == after[0][0] == "kor_Hang" and sum(s for _, s in before) == pytest.approx(1) and sum(s for _, s in after) < 1
    assert language_id.among(m, "", ("kor_Hang",)) == []
    with pytest.raises(ValueError):
        language_id.among(m, "x", ("spa_Latn",))


def test_profile_with_a_model(spark):
    df = spark.createDataFrame([("kcna_jp:1", "가나다라"), ("kcna_jp:2", "some text"), ("kcna_jp:3", None)], "id string, text string")
    got = documents.profile(df, language_id.identify(load, ("kor_Hang", "eng_Latn"))).select("language", F.col("language_score") > 0.5).collect()
    assert [tuple(r) for r in got] == [("kor_Hang", True), ("eng_Latn", True), (None, None)]
    assert [r[0] for r in df.select(language_id.all_labels(load)(F.col("text"))).collect()] == ["kor_Hang", "eng_Latn", "UNK"]


TEXTS = {
    "eng_Latn": ["The clerk of the town was sent away.", "A gate of the temple was closed.", "The letter was copied in the spring."], "fra_Latn": ["Le greffier de la ville fut renvoyé.", "Une porte du temple était fermée.", "La lettre fut copiée au printemps."],
    "spa_Latn": ["El escribano de la villa fue enviado.", "Una puerta del templo se cerró.", "La carta se copió en primavera."], "kor_Hang": ["마을의 노인이 편지를 읽었다.", "시장에서 소금을 팔았다."], "jpn_Jpan": ["これは村の手紙です。", "市場で塩を売りました。"],
}


def test_a_trained_model_reaches_all_languages(spark, tmp_path):
    names = spark.createDataFrame([(f" {x.upper()} ", x) for x in TEXTS], "language_label string, language string")
    docs = spark.createDataFrame([(t, x) for x, texts in TEXTS.items() for t in texts] + [(None, "eng_Latn"), ("", "eng_Latn"), ("x", None)], "text string, language string")
    texts, labels = language_id.labelled_sample(docs, names, per_label=2)
    assert len(texts) == 10 and set(labels) == set(TEXTS)
    path = str(tmp_path / "model")
    language_id.Letters.train([t for x in TEXTS.values() for t in x], [x for x, t in TEXTS.items() for _ in t]).save(path)
    identify = language_id.identify(language_id.saved(path), tuple(TEXTS))
    raw = spark.createDataFrame([("kcna_jp:1", "La carta de la villa se cerró."), ("kcna_jp:2", "The letter of the clerk was closed."), ("jpn_records:1", "La porte de la ville était fermée au printemps."), ("jpn_records:2", "市場の手紙です。")], "id string, text string")
    done = documents.classify(documents.profile(raw, identify), language_id.identify(language_id.saved(path), documents.RECORD_LABELS))
    assert {r["id"]: (r["category"], r["language"]) for r in done.collect()} == {"kcna_jp:1": ("es", "Spanish"), "kcna_jp:2": ("en", "English"), "jpn_records:1": ("fr", "French"), "jpn_records:2": ("ja", "Japanese")}


def test_without_a_model_words_tell_languages_in_latin_letters(spark):
    raw = spark.createDataFrame([("kcna_jp:1", "La carta de los hombres se cerró por el río."), ("kcna_jp:2", "The letter of the clerk was closed."), ("jpn_records:1", "Les portes de la ville et du temple."), ("magazine:1", "XYZ")], "id string, text string")
    profiled = documents.profile(raw)
    assert {r["id"]: r["language"] for r in profiled.collect()} == {"kcna_jp:1": "spa_Latn", "kcna_jp:2": "eng_Latn", "jpn_records:1": "fra_Latn", "magazine:1": "eng_Latn"}
    assert {r["id"]: r["category"] for r in documents.classify(profiled).collect()} == {"kcna_jp:1": "es", "kcna_jp:2": "en", "jpn_records:1": "fr", "magazine:1": "en"}
