"""What the planner makes of the stages: pruned scans, no shuffle where none is needed, ranks cut early."""

import re

import pytest
from pyspark.sql import functions as F

from hanstrata.operators import documents, pairs, sampling, tokens

ROW = "year double, token string, vowels string, token_source string, vowel_classes_core string, harmony_status_core string, vowel_classes_expanded string, harmony_status_expanded string, unused string, doc_id string"


def plan(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "rows")
    values = [(1500.0 + i % 200, f"가나{chr(0xAC00 + i % 50)}", "ㅏ,ㅏ", "hangul", "c", "h", "c", "h", "u", "d") for i in range(500)]
    spark.createDataFrame(values, ROW).write.parquet(path)
    return spark.read.parquet(path)


def test_counts_read_only_what_they_need(rows):
    text = plan(sampling.count_wordforms(rows))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text)[1]
    assert "unused" not in schema and "doc_id" not in schema and "token:" in schema
    assert "ArrowEvalPython" not in text and "PushedFilters: [" in text


def test_ranks_are_cut_before_the_shuffle(rows):
    settings = sampling.Sampling(min_window_wordforms=1, target_wordforms_per_window=5)
    counts = sampling.count_wordforms(rows, settings)
    text = plan(sampling.select_wordforms(counts, sampling.window_diagnostics(counts, settings), settings))
    assert len(re.findall(r"^\(\d+\) WindowGroupLimit", text, re.M)) == 2 and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_first_stages_do_not_shuffle(spark):
    raw = spark.createDataFrame([("newslibrary:1", "가나 다라", 1950.0)], "id string, text string, year double")
    text = plan(tokens.token_rows(documents.classify(documents.profile(raw))))
    assert "Exchange" not in text and "BatchEvalPython" not in text
    assert len(re.findall(r"^\(\d+\) ArrowEvalPython", text, re.M)) == 1


def test_scores_stay_in_the_engine(spark):
    df = spark.createDataFrame([("w", "ㅏ ㅓ")], "time_window_id string, d2l_sr string")
    text = plan(pairs.baseline_by_window(pairs.baseline_details(df)))
    assert "EvalPython" not in text and "InPandas" not in text and len(re.findall(r"^\(\d+\) Exchange", text, re.M)) == 1
    assert df.select(F.lit(1)).count() == 1


def test_small_samples_are_sent_and_large_ones_are_joined(rows, monkeypatch):
    settings = sampling.Sampling(min_window_wordforms=1, target_wordforms_per_window=5)
    counts = sampling.count_wordforms(rows, settings)
    selected = sampling.select_wordforms(counts, sampling.window_diagnostics(counts, settings), settings)
    sent = sampling.selected_token_rows(rows, selected, settings)
    text = plan(sent)
    assert text.index("BroadcastHashJoin") and "SortMergeJoin" not in text
    monkeypatch.setattr(sampling, "SENT_WORDFORMS", 0)
    joined = sampling.selected_token_rows(rows, selected, settings)
    key = lambda df: sorted((r["time_window_id"], r["wordform_id"], r["year"]) for r in df.collect())
    assert key(joined) == key(sent) != []


def test_weights_of_pairs_need_no_window(spark):
    df = spark.createDataFrame([("w", "a", "ㅏ ㅓ"), ("w", "b", "ㅏ ㅓ"), (None, "c", "ㅏ ㅓ"), ("w", "d", "ㅏ ㅑ")], "time_window_id string, wordform_id string, vowel_seq string")
    eligible, excluded = pairs.convert(df)
    assert "Window" not in re.sub("time_window_id", "", plan(eligible)) and {(r["time_window_id"], r["wordform_id"], r["lexical_type_weight"]) for r in eligible.collect()} == {("w", "a", 2), ("w", "b", 2), (None, "c", 1)}
    assert [r["wordform_id"] for r in excluded.collect()] == ["d"]


def test_a_csv_without_line_breaks_is_split(spark, tmp_path):
    from hanstrata.sources import files

    (tmp_path / "x.csv").write_text("a,b\n" + "".join(f"{i},{i}\n" for i in range(200_000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        df = files.read_csv(spark, str(tmp_path / "x.csv"), ["a"])
        assert df.rdd.getNumPartitions() > 1 and df.count() == 200_000
        assert files.read_csv(spark, str(tmp_path / "x.csv"), line_breaks=True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
