"""The learner and the baseline on two published windows, whose pairs and figures are stated here."""

import pytest
from pyspark.sql import functions as F

from hanstrata.operators import learning, pairs

# Pairs and weights of the windows, as they were published.
WINDOWS = {
    "1443-1542": """
ㅏ O|ㅏ ㅗ|1
ㅗ A|ㅗ ㅏ|1
ㅗ O EO|ㅗ ㅗ ㅓ|1
ㅜ A U U|ㅜ ㅏ ㅜ ㅜ|1
ㅣ EO EO|ㅣ ㅓ ㅓ|1
ㆍ ARAE|ㆍ ㆍ|1
ㆍ O A|ㆍ ㅗ ㅏ|1
ㆍ O ㅣ|ㆍ ㅗ ㅣ|2
ㆍ ㅣ EU|ㆍ ㅣ ㅡ|1
""",
    "1493-1592": """
ㅏ A|ㅏ ㅏ|3
ㅏ A A|ㅏ ㅏ ㅏ|1
ㅏ A O|ㅏ ㅏ ㅗ|1
ㅏ EU A|ㅏ ㅡ ㅏ|1
ㅏ O|ㅏ ㅗ|2
ㅏ ㅣ|ㅏ ㅣ|3
ㅏ ㅣ EO ㅣ|ㅏ ㅣ ㅓ ㅣ|1
ㅏ ㅣ O|ㅏ ㅣ ㅗ|1
ㅏ ㅣ ㅣ ㅣ A|ㅏ ㅣ ㅣ ㅣ ㅏ|1
ㅓ EO A|ㅓ ㅓ ㅏ|1
ㅓ EO EO|ㅓ ㅓ ㅓ|1
ㅓ EO ㅣ A|ㅓ ㅓ ㅣ ㅏ|2
ㅓ O O|ㅓ ㅗ ㅗ|1
ㅓ U|ㅓ ㅜ|1
ㅓ ㅣ|ㅓ ㅣ|1
ㅓ ㅣ A|ㅓ ㅣ ㅏ|1
ㅓ ㅣ EO|ㅓ ㅣ ㅓ|1
ㅗ A|ㅗ ㅏ|4
ㅗ O|ㅗ ㅗ|3
ㅗ O A ㅣ A|ㅗ ㅗ ㅏ ㅣ ㅏ|1
ㅗ U|ㅗ ㅜ|1
ㅗ ㅣ|ㅗ ㅣ|2
ㅗ ㅣ A|ㅗ ㅣ ㅏ|2
ㅜ EO|ㅜ ㅓ|1
ㅜ EO EU|ㅜ ㅓ ㅡ|1
ㅜ EO U|ㅜ ㅓ ㅜ|1
ㅜ O|ㅜ ㅗ|1
ㅜ O EU|ㅜ ㅗ ㅡ|1
ㅜ O O O|ㅜ ㅗ ㅗ ㅗ|1
ㅜ ㅣ|ㅜ ㅣ|2
ㅡ A ㅣ|ㅡ ㅏ ㅣ|1
ㅡ O|ㅡ ㅗ|2
ㅡ ㅣ|ㅡ ㅣ|2
ㅡ ㅣ EU|ㅡ ㅣ ㅡ|1
ㅡ ㅣ O|ㅡ ㅣ ㅗ|1
ㅣ A|ㅣ ㅏ|5
ㅣ EO EO|ㅣ ㅓ ㅓ|1
ㅣ EU|ㅣ ㅡ|2
ㅣ O ㅣ A|ㅣ ㅗ ㅣ ㅏ|1
ㅣ ㅣ|ㅣ ㅣ|2
ㅣ ㅣ O|ㅣ ㅣ ㅗ|1
ㆍ ARAE ARAE|ㆍ ㆍ ㆍ|1
ㆍ O A|ㆍ ㅗ ㅏ|1
ㆍ O ㅣ|ㆍ ㅗ ㅣ|2
ㆍ ㅣ EU|ㆍ ㅣ ㅡ|1
""",
}
# Of each step of the learner its predictions, correct ones, terminal status, deletion set afterwards and tier afterwards.
STEPS = {
    "1443-1542": [(15, 13, "TP_PASS", "", "NONE")],
    "1493-1592": [(75, 45, "RECURSE", "ㅓ ㅜ ㅣ", "¬[-RTR]"), (75, 48, "NO_NEW_REMOVABLE_CONTEXTS", "ㅓ ㅜ ㅣ", "¬[-RTR]")],
}
# Of the windows' baselines predictions, exceptions, tolerance test, scorable word forms, those with exceptions, and those that begin with ㅣ.
BASELINES = {"1443-1542": (13, 3, True, 9, 3, 1), "1493-1592": (63, 19, False, 46, 16, 12)}
# Context, source, failed predictions by structure and by weight, eligible ones, after a wrong one, in protected initial position, rank; of the second window's two steps.
FAILURES = {
    0: {
        ("ㅣ", "ORIGINAL_SPECIFIED_CONTEXT", 11, 17, 11, 0, 6, 1), ("ㅜ", "ORIGINAL_SPECIFIED_CONTEXT", 3, 3, 0, 0, 3, 2), ("ㅜ", "RESOLVED_TARGET_CONTEXT", 3, 3, 3, 3, 0, 2), ("ㅡ", "ORIGINAL_SPECIFIED_CONTEXT", 2, 3, 0, 0, 3, 2),
        ("ㅏ", "ORIGINAL_SPECIFIED_CONTEXT", 1, 1, 0, 0, 1, 3), ("ㅓ", "ORIGINAL_SPECIFIED_CONTEXT", 1, 1, 0, 0, 1, 3), ("ㅓ", "RESOLVED_TARGET_CONTEXT", 1, 1, 1, 0, 0, 3), ("ㅗ", "ORIGINAL_SPECIFIED_CONTEXT", 1, 1, 0, 0, 1, 3),
    },
    1: {
        ("ㅣ", "ORIGINAL_SPECIFIED_CONTEXT", 3, 7, 0, 0, 7, 1), ("ㅜ", "RESOLVED_TARGET_CONTEXT", 4, 4, 4, 4, 0, 2), ("ㅡ", "ORIGINAL_SPECIFIED_CONTEXT", 3, 4, 0, 0, 4, 2), ("ㅓ", "RESOLVED_TARGET_CONTEXT", 2, 3, 3, 0, 0, 3), ("ㅜ", "ORIGINAL_SPECIFIED_CONTEXT", 3, 3, 0, 0, 3, 3),
        ("ㅏ", "ORIGINAL_SPECIFIED_CONTEXT", 2, 2, 0, 0, 2, 4), ("ㅓ", "ORIGINAL_SPECIFIED_CONTEXT", 2, 2, 0, 0, 2, 4), ("ㅗ", "ORIGINAL_SPECIFIED_CONTEXT", 1, 1, 0, 0, 1, 5), ("ㆍ", "ORIGINAL_SPECIFIED_CONTEXT", 1, 1, 0, 0, 1, 5),
    },
}


@pytest.fixture(scope="module")
def rows(spark):
    listed = [(w, *line.split("|")[:2], int(line.split("|")[2])) for w, text in WINDOWS.items() for line in text.strip().splitlines()]
    return spark.createDataFrame(listed, "time_window_id string, d2l_ur string, d2l_sr string, lexical_type_weight int")


def test_steps_and_failures(rows):
    learned = learning.learn(rows).cache()
    trace = learning.exploded(learned, "trace").orderBy("time_window_id", "attempt_depth").collect()
    for window, steps in STEPS.items():
        got = [(t["selected_prediction_N"], t["selected_prediction_correct"], t["terminal_status"], t["delset_after"], t["tier_after"]) for t in trace if t["time_window_id"] == window]
        assert got == steps
    results = {r["time_window_id"]: r for r in learning.results(learned).collect()}
    assert {w: r["status"] for w, r in results.items()} == {"1443-1542": "RULE_LEARNED", "1493-1592": "NO_PRODUCTIVE_RULE"}
    assert results["1443-1542"]["weighted_full_form_accuracy"] == 0.8 and results["1443-1542"]["d2l_theta_N"] == pytest.approx(5.539040596032826)
    contexts = learning.failure_contexts(learning.exploded(learned, "events")).where("time_window_id = '1493-1592'").collect()
    for depth, wanted in FAILURES.items():
        got = {
            (c["context_segment"], c["context_source"], c["structural_failed_predictions"], c["weighted_failed_predictions"], c["weighted_eligible_for_delset"], c["weighted_errors_after_prior_misprediction"], c["weighted_protected_initial_context_errors"], c["failure_rank_within_candidate"])
            for c in contexts if c["attempt_depth"] == depth
        }
        assert got == wanted


def test_baselines(rows):
    each = rows.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("lexical_type_weight"))))
    for r in pairs.baseline_by_window(pairs.baseline_details(each)).collect():
        assert (r["prediction_N"], r["prediction_exceptions"], r["prediction_TP_pass"], r["wordform_N"], r["wordform_exceptions"], r["initial_i_unscored_wordforms"]) == BASELINES[r["time_window_id"]]
