"""Queries on skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hanstrata.operators.dense_keys import heavy_keys, key_totals, key_window_totals
from hanstrata.runtime import table

HEAVY_SHARE = 0.02


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    found = [heavy_keys(table(spark, folder, t), c, HEAVY_SHARE).select(F.lit(c).alias("field_name"), F.col("key").alias("key_value")) for t, c in (("token_rows", "wordform_id"), ("d2l_wordforms", "d2l_ur"))]
    return found[0].unionByName(found[1])


def p3_wordform_totals(spark: SparkSession, folder: str) -> DataFrame:
    totals = key_totals(table(spark, folder, "token_rows"), "wordform_id", "year", "year")
    return totals.select(F.col("key").alias("wordform_id"), "n_rows", F.col("low").alias("first_year"), F.col("high").alias("last_year"))


def p3_ur_window_totals(spark: SparkSession, folder: str) -> DataFrame:
    totals = key_window_totals(table(spark, folder, "d2l_wordforms"), "d2l_ur", ["run_name", "time_window_id"], "first_observed_year_in_window", "last_observed_year_in_window")
    return totals.select(F.col("key").alias("d2l_ur"), "n_rows", "n_windows", F.col("low").alias("first_year"), F.col("high").alias("last_year"))


QUERIES = {"p3_found": p3_found, "p3_wordform_totals": p3_wordform_totals, "p3_ur_window_totals": p3_ur_window_totals}

ORACLE = {
    "p3_found": """
        SELECT 'wordform_id' AS field_name, wordform_id AS key_value FROM token_rows WHERE wordform_id IS NOT NULL
        GROUP BY wordform_id HAVING count(*) >= 0.02 * (SELECT count(wordform_id) FROM token_rows)
        UNION ALL
        SELECT 'd2l_ur', d2l_ur FROM d2l_wordforms WHERE d2l_ur IS NOT NULL
        GROUP BY d2l_ur HAVING count(*) >= 0.02 * (SELECT count(d2l_ur) FROM d2l_wordforms)""",
    "p3_wordform_totals": """
        SELECT wordform_id, count(*) AS n_rows, CAST(trunc(min(year)) AS BIGINT) AS first_year, CAST(trunc(max(year)) AS BIGINT) AS last_year
        FROM token_rows WHERE wordform_id IS NOT NULL GROUP BY wordform_id""",
    "p3_ur_window_totals": """
        SELECT d2l_ur, count(*) AS n_rows, count(DISTINCT run_name || '/' || time_window_id) AS n_windows,
               CAST(min(first_observed_year_in_window) AS BIGINT) AS first_year, CAST(max(last_observed_year_in_window) AS BIGINT) AS last_year
        FROM d2l_wordforms WHERE d2l_ur IS NOT NULL GROUP BY d2l_ur""",
}
