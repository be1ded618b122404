"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hanstrata.llm.heavy_hitters import top_values
from hanstrata.llm.language import document_languages, label_repairs, line_parts
from hanstrata.llm.leakage import leaked_items
from hanstrata.llm.mixing import mix, mix_records, mix_report
from hanstrata.llm.residue import residue_documents
from hanstrata.llm.top_items import row_group_report, top_items
from hanstrata.llm.visual_form import inconsistent_vowels, lookalike_pairs, visual_classes, vowel_table, with_form
from hanstrata.runtime import fingerprint, shared_dir, table

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
TOP_VALUES = 20
TOP_WORDFORMS = 10


def _top(spark: SparkSession, folder: str) -> DataFrame:
    return top_values(table(spark, folder, "token_rows"), ["token", "wordform_id"], TOP_VALUES)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _top(spark, folder).select("field_name", "item_value")


def p4_top_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _top(spark, folder).select("field_name", "item_value", "n_rows", F.col("place").cast("int").alias("place"))


_FIRST = dict(group=["run_name", "time_window_id"], item="wordform_id", score="token_count_in_window", ties=["first_observed_year_in_window", "token", "vowel_seq"], n=TOP_WORDFORMS)


def p4_estimates(spark: SparkSession, folder: str) -> DataFrame:
    """The sketch's upper bound of each count beside the exact one."""
    return _top(spark, folder).select("field_name", "item_value", "estimate", "n_rows")


def _windows(spark: SparkSession, folder: str) -> dict:
    """The table, and where its clustered layout is kept: by what its files are, so that other files have another."""
    path = f"{folder}/window_wordforms.parquet"
    return {"df": table(spark, folder, "window_wordforms"), "keep": f"{shared_dir(spark)}/window_wordforms-{fingerprint(spark, path, *map(str, _FIRST.values()))}"}


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    first = top_items(**_windows(spark, folder), **_FIRST, rank_name="frequency_rank_in_window")
    return first.select("run_name", "time_window_id", "frequency_rank_in_window", "wordform_id")


def p2_row_groups(spark: SparkSession, folder: str) -> DataFrame:
    return row_group_report(**_windows(spark, folder), **_FIRST)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    texts = lookalike_pairs(table(spark, folder, "raw_documents"), "id", "text")
    vowels = inconsistent_vowels(table(spark, folder, "token_rows"), "token_row_id", "vowels")
    vowels = vowels.select(F.lit("vowels").alias("field_name"), F.col("key").cast("string").alias("key_a"), F.col("form").alias("key_b"))
    return texts.select(F.lit("text").alias("field_name"), "key_a", "key_b").unionByName(vowels)


def p6_leak_report(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "passage", "answer")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_leak_report(spark, folder).select("doc_id", "item_id")


def p8_residue(spark: SparkSession, folder: str) -> DataFrame:
    return residue_documents(table(spark, folder, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_residue(spark, folder).select("doc_id").distinct()


def p1_languages(spark: SparkSession, folder: str) -> DataFrame:
    found = document_languages(table(spark, folder, "raw_documents"), "id", "text", "language", table(spark, folder, "language_names"))
    return found.select("id", "segment_no", "language", F.round("confidence", 4).alias("confidence"), "label", "mixed")


def p1_line_parts(spark: SparkSession, folder: str) -> DataFrame:
    found = line_parts(table(spark, folder, "raw_documents"), "id", "text", "language", table(spark, folder, "language_names"))
    return found.withColumn("confidence", F.round("confidence", 4))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    found = label_repairs(table(spark, folder, "raw_documents"), "id", "text", "language", table(spark, folder, "language_names"))
    return found.select("id", "segment_no", "language")


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mix(table(spark, folder, "documents"), "doc_id", "text", "source", table(spark, folder, "mix_targets"), VOCABULARY)


def p7_mix_records(spark: SparkSession, folder: str) -> DataFrame:
    return mix_records(_mix(spark, folder)[0])


def p7_mix_report(spark: SparkSession, folder: str) -> DataFrame:
    return mix_report(*_mix(spark, folder))


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    return visual_classes(table(spark, folder, "raw_documents"), "id", "text").select("class_id", F.col("key").alias("id"), "text_hash")


def p5_consistent_vowels(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "token_rows").select("token_row_id", "vowels")
    return with_form(rows, "vowels", "vowels_consistent", vowel_table(), compose=False)


QUERIES = {"p5_classes": p5_classes, "p5_consistent_vowels": p5_consistent_vowels, "p7_mix_records": p7_mix_records, "p7_mix_report": p7_mix_report, "p1_found": p1_found, "p1_languages": p1_languages, "p1_line_parts": p1_line_parts, "p8_found": p8_found, "p8_residue": p8_residue, "p5_found": p5_found, "p6_found": p6_found, "p6_leak_report": p6_leak_report, "p2_found": p2_found, "p2_row_groups": p2_row_groups, "p4_found": p4_found, "p4_top_counts": p4_top_counts, "p4_estimates": p4_estimates}

_TOP_SQL = """
    SELECT field_name, item_value, n_rows, CAST(place AS INTEGER) AS place FROM (
      SELECT *, row_number() OVER (PARTITION BY field_name ORDER BY n_rows DESC, item_value) AS place FROM (
        SELECT 'token' AS field_name, token AS item_value, count(*) AS n_rows FROM token_rows WHERE token <> '' GROUP BY token
        UNION ALL
        SELECT 'wordform_id', wordform_id, count(*) FROM token_rows WHERE wordform_id <> '' GROUP BY wordform_id))
    WHERE place <= 20"""

ORACLE = {
    "p2_found": """
        SELECT run_name, time_window_id, CAST(place AS INTEGER) AS frequency_rank_in_window, wordform_id FROM (
          SELECT *, row_number() OVER (PARTITION BY run_name, time_window_id
                                       ORDER BY token_count_in_window DESC, first_observed_year_in_window, token, vowel_seq) AS place
          FROM (SELECT DISTINCT run_name, time_window_id, wordform_id, token_count_in_window, first_observed_year_in_window, token, vowel_seq
                FROM window_wordforms WHERE token_count_in_window IS NOT NULL)) WHERE place <= 10""",
    "p4_found": f"SELECT field_name, item_value FROM ({_TOP_SQL})",
    "p4_top_counts": _TOP_SQL,
}
