"""Stage operators on small cases, edge cases and a published run if there is one."""

import csv
import gzip
import json
import os
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from hanstrata.functions import harmony as H
from hanstrata.functions import text as X
from hanstrata.operators import dense_keys, documents, learning, lexicon, pairs, sampling, tokens
from hanstrata.plans.pipeline import Analysis, preprocess
from hanstrata.sources import config, files

RUN = os.environ.get("PUBLISHED_RUN", "")
needs_runs = pytest.mark.skipif(not os.path.isdir(RUN), reason="PUBLISHED_RUN names no folder")


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(v for v, _ in values.values())], ", ".join(f"{k} {t}" for k, (_, t) in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


# ---- keys ----


def test_key_totals_against_counting(spark, monkeypatch):
    monkeypatch.setattr(dense_keys, "ROWS_PER_ENCODING", 64)
    rows = [("hot" if i % 3 == 0 else f"k{i % 40}", 1900.0 + i % 7 if i % 5 else None, "x") for i in range(900)] + [(None, 1.0, "x"), ("", None, None)]
    df = spark.createDataFrame(rows, "key string, year double, count string").repartition(5)
    got = {r["key"]: (r["n_rows"], r["low"], r["high"]) for r in dense_keys.key_totals(df, "key", "year", "year").collect()}
    want = {}
    for k, y, _ in rows:
        if k is not None:
            n, years = want.setdefault(k, [0, []])
            want[k] = [n + 1, years + ([int(y)] if y is not None else [])]
    assert got == {k: (n, min(y) if y else None, max(y) if y else None) for k, (n, y) in want.items()}
    assert {r["key"] for r in dense_keys.heavy_keys(df, "key", 0.3).collect()} == {"hot"}
    assert dense_keys.key_totals(df.limit(0), "key").count() == 0 and dense_keys.heavy_keys(df.limit(0), "key", 0.1).count() == 0


def test_windows_of_keys(spark):
    df = spark.createDataFrame([("a", "r", "1"), ("a", "r", "1"), ("a", "s", "1"), ("a", None, "1"), (None, "r", "1")], "k string, run string, w string")
    assert [tuple(r)[:3] for r in dense_keys.key_window_totals(df, "k", ["run", "w"]).collect()] == [("a", 4, 2)]


# ---- texts ----


@pytest.mark.parametrize("text", ["", "  ", "a \t b", " a \n\n\n b ", "　가 나 다", "x\x1cy\x1c", "a\r\nb", "\x00a\x07", None])
def test_white_space_and_controls(spark, text):
    def want(t):
        t = unicodedata.normalize("NFKC", t)
        ws = r"[\t\x0b-\r \x85\xa0  -     　]"
        t = re.sub(rf"{ws}*\n{ws}*", "\n", t)
        t = re.sub(rf"{ws}+", " ", re.sub(r"\n+", "\n", t)).strip()
        return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "", t)

    assert text is None or X.stored_form(text) == want(text)
    assert one(spark, X.normalize(F.col("t")), t=(text, "string")) == (None if text is None else want(text))


def test_script_shares_agree_in_both_ways(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["한국어 text", "漢字와 한글", "ᄀᆞᄅᆞᆷ", "カタカナ 漢字", "12. 34", "", None, "ㆍᆞ", "〇々"])], "i int, text string")
    a = {r["i"]: r for r in X.with_script_ratios(df.withColumn("text", X.nfkc("text")), "text").collect()}
    b = {r["i"]: r for r in X.with_normal_text(df).collect()}
    for i in a:
        for k in X.SCRIPTS:
            assert a[i][f"script_{k}"] == pytest.approx(b[i][f"script_{k}"]), (i, k)
    assert a[0]["script_kor"] == pytest.approx(3 / 7) and a[4]["script_lat"] == 0


# ---- vowels ----


@pytest.mark.parametrize(("v", "core", "expanded"), [
    ("ㅏㅗ", "harmonic", "harmonic"), ("ㅏㅣㅗ", "harmonic_with_neutral", "harmonic_with_neutral"), ("ㅏㅓ", "disharmonic", "disharmonic"), ("ㅏㅑ", "unclassifiable_due_to_other", "harmonic"),
    ("ㅏㅘ", "unclassifiable_due_to_other", "harmonic"), ("ㅘㅝ", "unclassifiable_due_to_other", "disharmonic"), ("ㅏㅢ", "unclassifiable_due_to_other", "disharmonic"), ("ㅣ", "neutral_only", "neutral_only"), ("", "neutral_only", "neutral_only"),
])
def test_harmony(spark, v, core, expanded):
    letters = F.filter(F.split(F.lit(v), ""), lambda c: c != "")
    assert one(spark, F.struct(H.harmony_status(H.vowel_classes(letters, "core")), H.harmony_status(H.vowel_classes(letters, "expanded")))) == (core, expanded)


@pytest.mark.parametrize("token", ["가나다", "ᄀᆞᄅᆞᆷ", "ㅎㅏㄴ", "뎨ᅀᅵㆎ", "ᆡ", "ᅠ", ""])
def test_vowels_against_names(spark, token):
    compat = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣㆍㆎ"
    want = []
    for c in unicodedata.normalize("NFD", token):
        if "HANGUL JUNGSEONG" in unicodedata.name(c, "") or c in compat:
            want.append(compat[ord(c) - 0x1161] if 0x1161 <= ord(c) <= 0x1175 else "ㆍ" if c == "ᆞ" else c)
    assert one(spark, H.vowels(F.lit(token))) == want


@pytest.mark.parametrize(("year", "phase"), [("1499", "before"), ("1500", "during"), ("1599.9", "during"), ("1600", "after"), (None, "unknown"), ("x", "unknown"), ("NaN", "unknown")])
def test_event_phase(spark, year, phase):
    assert one(spark, H.event_phase(F.col("y"), 1500, 1599), y=(year, "string")) == phase


def _contexts(text):
    out = []
    for m in re.finditer("[가-힣]+", text):
        left, right = text[max(0, m.start() - 12) : m.start()], text[m.end() : m.end() + 12]
        if left.endswith("(") and right.startswith(")"):
            out.append("parenthetical_hanja_reading" if re.search(r"[一-龥]\($", left) else "parenthetical_hangul")
        else:
            out.append("near_hanja" if re.search("[一-龥]", left + right) else "plain_hangul")
    return out


@pytest.mark.parametrize("text", ["漢字(한자)와 글", "(가) 나다 x", "漢 abcdefghij 가", "漢 abcdefghijk 가", "가 abcdefghij 漢", "가 abcdefghijk 漢", "가나(다라) 漢(마)", "", "漢가字나"])
def test_token_context_against_brute_force(spark, text):
    assert [t["token_context"] for t in one(spark, tokens.tokens_in_context(F.lit(text)))] == _contexts(text)


# ---- documents ----


def test_classification(spark):
    rows = [
        ("sillok:1", "史臣曰", 1500.0, "Hanmun"), ("kisu_journal:1", "글이다", 1990.0, "North Korean"), ("gaksa:1", "漢字와 한글", 1700.0, "Early Modern Korean"), ("newslibrary:1", "신문 기사", 1950.0, "Modern Korean"),
        ("newslibrary:2", "신문 기사", None, "Korean"), ("aks_book:1", "글이다", 1500.0, "Middle Korean"), ("aks_book:2", "漢漢漢漢漢漢漢漢漢글", 1500.0, "Hanmun"), ("aks_book:3", "글이다", 900.0, None), ("stranger:1", "글이다", 1900.0, None),
        ("jpn_records:1", "カタカナです", 1900.0, "Japanese"), ("gongu:1", "가나(漢字) 다라[文字]", 1900.0, "Hanmun"),
    ]
    dropped = [("sillok:2", "", 1500.0), ("sillok:3", " \n", 1500.0), ("sillok:4", "12. 34", 1500.0), ("newslibrary:3", "αβγ", 1950.0)]
    df = spark.createDataFrame([r[:3] for r in rows] + dropped, "id string, text string, year double")
    got = {r["id"]: r["language"] for r in documents.classify(documents.profile(df)).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_before_hangul(spark):
    df = spark.createDataFrame([("hj+oko", 1445.0), ("hj+ko", 1400.0), ("ko", 1400.0), ("hj+oko", 1446.0), ("hj+oko", None), (None, 1400.0)], "c string, y double")
    assert [r[0] for r in df.select(documents.before_hangul(F.col("c"), F.col("y"))).collect()] == ["hj", "hj", "ko", "hj+oko", "hj+oko", None]


# ---- dictionary ----


def test_matches_and_readings(spark):
    own = lexicon.Lexicon.build([{"idu_text": "A", "hangul_text": "가"}, {"idu_text": "AB", "hangul_text": "가나, 다라"}, {"idu_text": "AB", "hangul_text": "가나, 다라"}, {"idu_text": "", "hangul_text": "x"}, {"idu_text": "Z"}])
    assert own.matches("xＡB y") == [(1, 3, "AB")] and len(own.entries["AB"]) == 1
    assert lexicon.Lexicon.load(None).matches("x") == [] and lexicon.Lexicon().automaton() is None
    assert [r["reading"] for r in one(spark, lexicon.reading_column(F.lit("가나, 다라")))] == ["가나", "다라"]
    assert one(spark, lexicon.reading_column(F.lit("가나다라마바사")))[0]["note"].endswith("concatenated_variants") and one(spark, lexicon.reading_column(F.lit(None).cast("string"))) == []
    docs = documents.classify(documents.profile(spark.createDataFrame([("gaksa:1", "xＡB y", 1700.0)], "id string, text string, year double")))
    rows = tokens.token_rows(docs, tokens.Extraction(min_vowels=1, exclude_idu_derived_wordforms=False), own).collect()
    assert sorted(r["token"] for r in rows) == ["가나", "다라"] and list(rows[0].asDict()) == list(tokens.COLUMNS)


def test_matches_against_an_alternation():
    import random

    rng = random.Random(6)
    for _ in range(200):
        words = {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(6)}
        own = lexicon.Lexicon.build([{"idu_text": w, "hangul_text": "가"} for w in words])
        text = "".join(rng.choices("abcd", k=30))
        pattern = re.compile("|".join(sorted(words, key=lambda w: -len(w))))
        assert own.matches(text) == [(m.start(), m.end(), m.group()) for m in pattern.finditer(text)]
    own = lexicon.Lexicon.build([{"idu_text": "k", "hangul_text": "가"}, {"idu_text": "gx", "hangul_text": "나"}])
    assert own.matches("㎏x") == [(0, 1, "k")]  # the rest of a character that a match has used is used as well


def test_classifier():
    c = lexicon.IduClassifier({"等乙", "去乙", "爲去乎", "水刺"}, ["爲", "去"], {"不得"}, {"水刺"})
    assert c.classify(None)["reason"] == "no_text" and c.classify("12")["reason"] == "no_valid_letters" and c.classify("한글 글월")["pred"] == "other"
    assert c.classify("右人等乙依法施行爲去乎")["pred"] == "kr" and c.classify("天地玄黃宇宙洪荒")["pred"] == "cc" and c.classify("水刺進上")["pred"] == "cc"
    assert c.classify("去乙丑年")["matched"] == [] and c.classify("(右)等乙")["spans"][0]["start"] == 3


# ---- samples ----

ROW = "year string, token string, vowels string, token_source string, vowel_classes_core string, harmony_status_core string, vowel_classes_expanded string, harmony_status_expanded string"


def _rows(spark, rows):
    return spark.createDataFrame([(str(y) if y is not None else None, t, v, "hangul", "c", "h", "c", "h") for y, t, v in rows], ROW)


def test_vowel_bounds_and_cap(spark):
    df = _rows(spark, [(1500, "aa", "ㅏ,ㅏ"), (1500, "bbb", "ㅏ,ㅏ,ㅏ"), (None, "aa", "ㅏ,ㅏ"), ("x", "aa", "ㅏ,ㅏ"), (1500, " ", "ㅏ,ㅏ"), (1500, None, "ㅏ,ㅏ"), (1500, "aa", None), (1400, "aa", "ㅏ,ㅏ")])
    counts = sampling.count_wordforms(df, sampling.Sampling(min_word_vowels=2, max_word_vowels=2)).collect()
    assert {(r["time_window_id"], r["token"], r["token_count_in_window"]) for r in counts} == {("1443-1542", "aa", 1), ("1493-1592", "aa", 1)}
    many = _rows(spark, [(1450, t, "ㅏ,ㅏ") for t, n in zip("abcd", (10, 9, 8, 7), strict=True) for _ in range(n)])
    s = sampling.Sampling(target_wordforms_per_window=3, max_wordforms_per_window=2)
    counts = sampling.count_wordforms(many, s)
    assert [r["token"] for r in sampling.select_wordforms(counts, sampling.window_diagnostics(counts, s), s).orderBy("frequency_rank_in_window").collect()] == ["a", "b"]


@pytest.mark.parametrize(("width", "step"), [(100, 50), (25, 25), (100, 30), (10, 25)])
def test_year_windows_against_enumeration(spark, width, step):
    years = list(range(1400, 1700, 7))
    df = spark.createDataFrame([(y,) for y in years], "y int").select("y", sampling.year_windows(F.col("y"), 1443, width, step).alias("w"))
    for r in df.collect():
        assert [w["start"] for w in r["w"]] == [s for s in range(1443, 1800, step) if s <= r["y"] <= s + width - 1]


def test_no_eligible_window(spark):
    s = sampling.Sampling(min_window_tokens=10)
    counts = sampling.count_wordforms(_rows(spark, [(1500, "aa", "ㅏ,ㅏ")]), s)
    with pytest.raises(ValueError):
        sampling.select_wordforms(counts, sampling.window_diagnostics(counts, s), s)


# ---- published runs ----


def _published(name):
    with open(f"{RUN}/{name}", encoding="utf-8-sig") as f:
        return {r["time_window_id"]: r for r in csv.DictReader(f)}


@needs_runs
def test_baseline_and_learner_on_published_pairs(spark):
    rows = files.read_window_pairs(spark, f"{RUN}/d2l_core/window_pairs").cache()
    assert rows.count() == 1619
    each = rows.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("lexical_type_weight"))))
    got = {r["time_window_id"]: r for r in pairs.baseline_by_window(pairs.baseline_details(each)).collect()}
    for window, want in _published("baseline/baseline_exception_rate_by_window.csv").items():
        for c in ("prediction_N", "prediction_exceptions", "wordform_N", "wordform_exceptions", "scorable_wordforms", "initial_i_unscored_wordforms", "no_later_harmonic_target_wordforms"):
            assert got[window][c] == int(want[c])
        assert str(got[window]["prediction_TP_pass"]) == want["prediction_TP_pass"] and got[window]["prediction_theta_N"] == pytest.approx(float(want["prediction_theta_N"]))
    learned = {r["time_window_id"]: r for r in learning.results(learning.learn(rows)).collect()}
    for window, want in _published("d2l_results_progressive_protected/d2l_results_by_window.csv").items():
        assert learned[window]["status"] == want["status"] and learned[window]["harmony_initial_prediction_exceptions"] == int(float(want["harmony_initial_prediction_exceptions"]))


def test_bad_window_is_reported(spark):
    df = spark.createDataFrame([("1-2", "ㅏ A", "ㅏ ㅏ", 0), ("3-4", "ㅏ ㅣ", "ㅏ ㅣ", 1)], "time_window_id string, d2l_ur string, d2l_sr string, lexical_type_weight int")
    assert {r["time_window_id"]: r["status"] for r in learning.learn(df).collect()} == {"1-2": "ERROR", "3-4": "NO_D2L_TARGETS"}


# ---- files and runs ----


def test_files_to_results(spark, tmp_path):
    (tmp_path / "in/a").mkdir(parents=True)
    docs = [{"id": f"newslibrary:{i}", "text": "가나 다라마 고노 구누디 가니다 " * 3, "year": 1900 + i} for i in range(6)]
    with open(tmp_path / "in/a/x.jsonl", "w", encoding="utf-8") as f:
        f.write("\n".join(json.dumps(d, ensure_ascii=False) for d in docs[:3]) + "\n\nnot json\n")
    with gzip.open(tmp_path / "in/y.jsonl.gz", "wt", encoding="utf-8") as f:
        f.write("\n".join(json.dumps(d, ensure_ascii=False) for d in docs[3:]) + '\n{"id": "q:1", "text": null}\n')
    assert [p.name for p in files.discover(tmp_path / "in")] == ["x.jsonl", "y.jsonl.gz"]
    with pytest.raises(FileNotFoundError):
        files.discover(tmp_path / "in", ["*.csv"])
    assert str(files.output_path(tmp_path / "in/a/x.jsonl", tmp_path / "in", "out")) == "out/a/x.processed.jsonl"
    raw, seen = files.read_documents(spark, str(tmp_path / "in"))
    assert raw.count() == 6 and seen.get["bad_lines"] == 1 and seen.get["documents_used"] == 6
    run = Analysis(raw, sampling=sampling.Sampling(min_window_wordforms=1))
    run.write(str(tmp_path / "out"))
    assert files.read_csv(spark, str(tmp_path / "out/sampled_time_window_wordforms"), ["wordform_id"]).count() == run.sample.count() > 0
    assert {r["status"] for r in run.results.collect()} <= {"RULE_LEARNED", "NO_PRODUCTIVE_RULE"}
    back = files.read_window_pairs(spark, str(tmp_path / "out/d2l_core/window_pairs"))
    assert back.count() == run.weighted_pairs.count()
    done, counts = preprocess(spark, config.Preprocessing(str(tmp_path / "in"), str(tmp_path / "done")))
    assert done.count() == 6 and "script.kor" in done.columns and (counts["documents_used"], counts["bad_lines"], counts["texts_not_strings"]) == (6, 1, 1)
    assert {str(p.parent.relative_to(tmp_path / "done")) for p in (tmp_path / "done").rglob("part-*")} == {"a/x.processed.jsonl", "y.processed.jsonl"}
    assert preprocess(spark, config.Preprocessing(str(tmp_path / "in"), str(tmp_path / "done")))[1] == {}
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "out/time_window_diagnostics"), ["nope"])


def test_lines_whose_values_are_of_other_types(spark, tmp_path):
    lines = ['{"id": "a:1", "text": "s", "year": "1900"}', '{"id": "a:2", "text": 123}', '{"id": "a:3", "text": ["x"]}', '{"id": "a:4", "text": null}', '{"id": "a:5"}', "", "no json", '{"id": "a:6", "text": "q", "year": "x"}', '{"id": 7, "text": "123", "year": 1900.5}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines), encoding="utf-8")
    raw, seen = files.read_documents(spark, str(tmp_path))
    assert {(r["id"], r["text"], r["year"]) for r in raw.collect()} == {("a:1", "s", 1900.0), ("a:6", "q", None), ("7", "123", 1900.5)}
    assert seen.get == {"documents_seen": 8, "bad_lines": 1, "texts_not_strings": 4, "documents_used": 3}


def test_a_failed_job_is_done_again(spark, tmp_path):
    rows = spark.createDataFrame([("a:1", "x"), ("a:2", "y")], "id string, text string")
    broken = rows.select("id", F.raise_error(F.lit("stop")).cast("string").alias("text"))
    with pytest.raises(Exception, match="stop"):
        files.write_documents(broken, str(tmp_path / "out"))
    files.write_documents(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    files.write_documents(rows.limit(1), str(tmp_path / "out"))  # a finished result is left alone
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_charts_refuse_what_is_no_summary(spark, tmp_path, monkeypatch):
    pytest.importorskip("matplotlib")
    monkeypatch.setattr(files, "MAX_POINTS", 3)
    with pytest.raises(ValueError, match="4 windows"):
        files.line_charts(spark.range(4).withColumnRenamed("id", "time_window_start").withColumn("n", F.lit(1)), tmp_path, ["n"])


def test_own_features_reach_the_learner(spark, tmp_path):
    table = [["SEG", "syl", "tongue", "RTR"]] + [[s, "+", "+" if s == "ㅣ" else "-", v["RTR"]] for s, v in files.read_features().items()]
    (tmp_path / "f.tsv").write_text("\n".join("\t".join(r) for r in table), encoding="utf-8")
    own = files.read_features(tmp_path / "f.tsv")
    rows = [("ㅏ A", "ㅏ ㅏ"), ("ㅓ EO", "ㅓ ㅓ"), ("ㅏ EO", "ㅏ ㅏ"), ("ㅓ A", "ㅓ ㅓ"), ("ㅏ ㅣ A", "ㅏ ㅣ ㅏ"), ("ㅓ ㅣ A", "ㅓ ㅣ ㅓ"), ("ㅏ ㅣ EO", "ㅏ ㅣ ㅏ")]
    df = spark.createDataFrame([("1-2", u, s, 10) for u, s in rows], "time_window_id string, d2l_ur string, d2l_sr string, lexical_type_weight int")
    trace = learning.exploded(learning.learn(df, features=own), "trace").collect()
    assert "[+tongue]" in {t["chosen_natural_class"] for t in trace}
    with pytest.raises(ValueError, match="without features"):
        learning.learn(df, features={"ㅏ": {"RTR": "+"}})


def test_baseline_belongs_one_to_one(spark):
    summary = spark.createDataFrame([("a", 1), ("b", 2)], "time_window_id string, n int")
    base = spark.createDataFrame([("a", 5)], "time_window_id string, prediction_N int")
    assert {tuple(r) for r in learning.with_baseline(summary, base).collect()} == {("a", 1, 5), ("b", 2, None)}
    for left, right in ((summary.unionAll(summary), base), (summary, base.unionAll(base))):
        with pytest.raises(Exception, match="more than once"):
            learning.with_baseline(left, right).collect()


def test_commands_from_files_to_results(spark, tmp_path):
    from hanstrata.plans import commands

    (tmp_path / "in/a").mkdir(parents=True)
    docs = [{"id": f"newslibrary:{i}", "text": "가나 다라마 고노 구누디 가니다 奏請 漢字(한자) " * 3, "year": 1900 + i} for i in range(6)]
    (tmp_path / "in/a/x.jsonl").write_text("\n".join(json.dumps(d, ensure_ascii=False) for d in docs) + "\nnot json\n", encoding="utf-8")
    (tmp_path / "words.json").write_text(json.dumps([{"sequence": 1, "idu_text": "奏請", "hangul_text": "주청, 주쳥"}], ensure_ascii=False), encoding="utf-8")
    (tmp_path / "s.json").write_text('{"min_window_wordforms": 1, "target_wordforms_per_window": 5}', encoding="utf-8")
    done, rows, run = (str(tmp_path / x) for x in ("done", "rows", "run"))
    assert commands.main(["preprocess", str(tmp_path / "in"), done], spark)["bad_lines"] == 1
    counts = commands.main(["extract", done, rows, "--dictionary", str(tmp_path / "words.json"), "--min-vowels", "2"], spark)
    assert counts == {"documents_used": 6, "hangul_rows": 6 * 3 * 6, "idu_matches": 18, "idu_rows_emitted": 0, "idu_rows_suppressed": 36}
    assert commands.main(["sample", rows, run, "--config", str(tmp_path / "s.json"), "--max-word-vowels", "4"], spark)["sampled_wordforms"] == 10
    assert commands.main(["pair", run, run], spark)["eligible_wordforms"] == 10
    assert commands.main(["baseline", run, run, "--initial-i-policy", "minus-rtr"], spark)["windows"] == 2 == commands.main(["learn", run, run], spark)["windows"]
    assert json.loads((tmp_path / "run/sampling_config.json").read_text())["target_wordforms_per_window"] == 5 and json.loads((tmp_path / "run/baseline/baseline_analysis_config.json").read_text())["initial_i_policy"] == "minus-rtr"
    for name in ("sampled_time_window_wordforms", "sampled_time_window_original_token_rows", "time_window_diagnostics", "excluded_time_windows", "d2l_core/d2l_weighted_pairs", "baseline/baseline_exception_rate_by_window", "d2l_results/d2l_results_by_window"):
        first = next((tmp_path / "run" / name).glob("part-*.csv")).read_bytes()
        assert first.startswith(b"\xef\xbb\xbf"), name  # also without rows
    found = files.read_csv(spark, f"{run}/d2l_results/d2l_results_by_window", ["time_window_id", "baseline_prediction_N", "initial_harmony_top_error_contexts"])
    assert found.count() == 2
    with pytest.raises(ValueError, match="usage"):
        commands.main(["nope"], spark)


def test_a_run_writes_token_rows_details_and_settings(spark, tmp_path):
    docs = [(f"newslibrary:{i}", "가나 다라마 고노 구누디 가니다 " * 3, 1900.0 + i) for i in range(6)]
    run = Analysis(spark.createDataFrame(docs, "id string, text string, year double"), sampling=sampling.Sampling(min_window_wordforms=1))
    run.write(str(tmp_path / "out"))
    rows = files.read_csv(spark, str(tmp_path / "out/sampled_time_window_original_token_rows"), ["time_window_id", "wordform_id", "doc_id", "token"])
    counted = {(r["time_window_id"], r["wordform_id"]): r["token_count_in_window"] for r in run.sample.collect()}
    assert counted and {(r["time_window_id"], r["wordform_id"]): r["count"] for r in rows.groupBy("time_window_id", "wordform_id").count().collect()} == counted
    assert files.read_csv(spark, str(tmp_path / "out/baseline/baseline_wordform_details"), ["time_window_id"]).count() == run.baseline_details.count() > 0
    said = json.loads((tmp_path / "out/sampling_config.json").read_text())
    assert (said["min_window_wordforms"], said["anchor_year"], said["window_overlap_years"]) == (1, 1443, 50)
    assert json.loads((tmp_path / "out/baseline/baseline_analysis_config.json").read_text())["initial_i_policy"] == "unscored"
    assert all((tmp_path / "out" / name).exists() for name in ("d2l_core/d2l_input_config.json", "d2l_results/d2l_run_config.json"))


def test_stream_gives_the_same_rows(spark, tmp_path):
    from hanstrata.streaming import stages

    (tmp_path / "in").mkdir()
    docs = [{"id": f"newslibrary:{i}", "text": "가나 다라마 漢字(한자)", "year": 1900.0 + i} for i in range(4)]
    for k in range(2):
        (tmp_path / f"in/{k}.jsonl").write_text("\n".join(json.dumps(d, ensure_ascii=False) for d in docs[2 * k : 2 * k + 2]), encoding="utf-8")
    query = stages.write(stages.token_rows(stages.read_documents(spark, str(tmp_path / "in"), 1)), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    batch = Analysis(files.read_documents(spark, str(tmp_path / "in"))[0]).token_rows
    key = lambda df: sorted((r["doc_id"], r["token"], r["token_context"]) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(batch)


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"window_width": 25, "window_step": 25, "exclude_windows": ["1-2"], "unknown": 1, "run_name": "r"}')
    s = config.from_command_line(sampling.Sampling, ["--config", str(path), "--window-step", "10"])
    assert (s.window_width, s.window_step, s.exclude_windows, s.start_year) == (25, 10, ("1-2",), 1443)
    e = config.load(tokens.Extraction, None, arae_initial_merger=(1, 2))
    assert e.arae_initial_merger == (1, 2)
    config.echo(s, tmp_path / "echo.json", anchor_year=1443)
    assert json.loads((tmp_path / "echo.json").read_text())["window_overlap_years"] == 15
    for bad in (lambda: config.Pairs(core_only=False), lambda: config.load(sampling.Sampling, path, required=("runs_dir",)), lambda: sampling.Sampling(window_step=0), lambda: config.load(config.Pairs, None, x=1)):
        with pytest.raises(ValueError):
            bad()
    assert files.read_features()["ㅣ"]["RTR"] == "-"
