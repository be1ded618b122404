"""Stages 07 and 09: sampled word forms to weighted pairs, and their harmony exception rates."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hanstrata.functions import inventory as V
from hanstrata.runtime import require_columns

_CORE = list(V.CORE)
_HARMONIC = [v for v, c in V.CORE.items() if c != V.NEUTRAL]


def parse_sequence(c: Column) -> Column:
    """The parts of a sequence that is joined by blanks; empty for null."""
    return F.coalesce(F.filter(F.split(F.trim(c), r"\s+"), lambda v: v != ""), F.array().cast("array<string>"))


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _noncore(v: Column) -> Column:
    return F.array_sort(F.array_except(v, _array(_CORE)))


def exclusion_reason(v: Column, min_vowels: int) -> Column:
    """Why a sequence can't be converted; null if it can."""
    return F.when(F.size(v) < min_vowels, "BELOW_MIN_VOWELS").when(F.size(_noncore(v)) > 0, F.concat(F.lit("NONCORE_VOWEL:"), F.array_join(_noncore(v), ",")))


def underlying(v: Column) -> Column:
    """The underlying form: vowels but the first become abstract targets; ㅣ stays."""
    table = F.create_map(*(F.lit(x) for pair in V.TARGET_OF.items() for x in pair))
    return F.transform(v, lambda x, i: F.when(i == 0, x).otherwise(F.coalesce(F.try_element_at(table, x), x)))


def _later(v: Column, test) -> Column:
    return F.size(F.filter(v, lambda x, i: (i > 0) & test(x)))


def _rtr(c: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in V.CORE.items() for x in pair)), c)


def convert(sample: DataFrame, window: str = "time_window_id", sequence: str = "vowel_seq", min_vowels: int = 2) -> tuple[DataFrame, DataFrame]:
    """(eligible, excluded): word forms with their pair columns, and those that can't be converted, with the reason."""
    require_columns(sample, window, sequence)
    work = sample.withColumn("_v", parse_sequence(F.col(sequence))).withColumn("d2l_exclusion_reason", exclusion_reason(F.col("_v"), min_vowels))
    v = F.col("_v")
    eligible = work.where(F.col("d2l_exclusion_reason").isNull()).withColumns({
        "d2l_ur": F.array_join(underlying(v), " "), "d2l_sr": F.array_join(v, " "), "d2l_initial_vowel": v[0], "d2l_num_segments": F.size(v),
        "d2l_num_targets": _later(v, lambda x: x.isin(*_HARMONIC)), "d2l_num_noninitial_i": _later(v, lambda x: x == "ㅣ"), "d2l_contains_arae": F.array_contains(v, "ㆍ"),
    })
    eligible = eligible.withColumns({
        "d2l_pair_key": F.concat_ws("\t", "d2l_ur", "d2l_sr"), "d2l_initial_rtr_class": _rtr(F.col("d2l_initial_vowel")),
        "d2l_contains_noninitial_i": F.col("d2l_num_noninitial_i") > 0, "d2l_has_prediction_target": F.col("d2l_num_targets") > 0,
    })
    # counts of pairs are few and are added up before they travel; a window over a pair would bring all its rows to one task
    pair = [window, "d2l_ur", "d2l_sr"]
    counts = eligible.groupBy(*pair).agg(F.count("*").cast("int").alias("lexical_type_weight")).withColumnsRenamed({c: f"_{i}" for i, c in enumerate(pair)})
    same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(pair)]
    eligible = eligible.join(counts, reduce(and_, same)).drop("_0", "_1", "_2")
    eligible = eligible.withColumn("d2l_pair_is_shared_by_multiple_wordforms", F.col("lexical_type_weight") > 1)
    return eligible.drop("_v", "d2l_exclusion_reason"), work.where(F.col("d2l_exclusion_reason").isNotNull()).drop("_v")


def weighted_pairs(eligible: DataFrame, window: str = "time_window_id", wordform: str = "wordform_id", token: str = "token", order: str = "frequency_rank_in_window") -> DataFrame:
    """One row for each pair of a window, with its weight and what it represents, in the order of `order`."""
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(wordform).alias("w"), F.col(c).alias("x")))), lambda s: s["x"]), " ||| ")
    return eligible.groupBy(window, "d2l_ur", "d2l_sr").agg(
        F.count("*").cast("int").alias("lexical_type_weight"), listed(wordform).alias("represented_wordform_ids"), listed(token).alias("represented_tokens"),
        *(F.min(c).alias(c) for c in ("d2l_num_segments", "d2l_num_targets", "d2l_contains_noninitial_i", "d2l_contains_arae")),
    )


def pair_diagnostics(sample: DataFrame, window: str = "time_window_id", sequence: str = "vowel_seq", min_vowels: int = 2) -> DataFrame:
    """Counts and shares of each window's conversion, in two aggregations: by pair, then by window."""
    v = parse_sequence(F.col(sequence))
    work = sample.select(F.col(window), v.alias("v")).withColumn("bad", exclusion_reason(F.col("v"), min_vowels).isNotNull())
    pair = F.when(~F.col("bad"), F.array_join("v", " "))
    by_pair = work.groupBy(window, "bad", pair.alias("pair")).agg(
        F.count("*").alias("n"), F.count_if(_later(F.col("v"), lambda x: x.isin(*_HARMONIC)) > 0).alias("targets"), F.count_if(_later(F.col("v"), lambda x: x == "ㅣ") > 0).alias("with_i")
    )
    total = lambda c, condition: F.coalesce(F.sum(F.when(condition, F.col(c))), F.lit(0))
    good = ~F.col("bad")
    out = by_pair.groupBy(window).agg(
        F.sum("n").alias("sampled_wordforms_input"), total("n", good).alias("d2l_eligible_lexical_wordforms"), F.count_if(good).alias("unique_vowel_only_d2l_pairs"),
        total("targets", good).alias("lexical_wordforms_with_at_least_one_target"), total("with_i", good).alias("lexical_wordforms_with_noninitial_i"), total("n", F.col("bad")).alias("excluded_wordforms"),
    )
    beyond = F.col("d2l_eligible_lexical_wordforms") - F.col("unique_vowel_only_d2l_pairs")
    return out.withColumns({
        "lexical_types_represented_by_weights_beyond_unique_pairs": beyond,
        "fraction_lexical_types_collapsed_structurally": F.try_divide(beyond, F.col("d2l_eligible_lexical_wordforms")),
        "fraction_sample_excluded_from_core_inventory": F.try_divide(F.col("excluded_wordforms"), F.col("sampled_wordforms_input")),
    })


def theta(n: Column) -> Column:
    """The most exceptions that a productive rule over n items can have; null for n of 1 or less."""
    return F.when(n > 1, n / F.log(n.cast("double")))


def tolerance_pass(n: Column, errors: Column) -> Column:
    correct = n - errors
    return F.coalesce((n > 1) & (correct > 1) & (correct >= n / 2) & (errors <= theta(n)), F.lit(False))


def score(v: Column, initial_i: str = "unscored") -> dict[str, Column]:
    """How far a sequence agrees with its first vowel; `initial_i` is unscored or minus-rtr."""
    if initial_i not in ("unscored", "minus-rtr"):
        raise ValueError("initial_i is unscored or minus-rtr")
    first = F.try_element_at(v, F.lit(1))
    rtr = F.when(first == "ㅣ", V.MINUS).otherwise(_rtr(first))
    targets = F.filter(v, lambda x, i: (i > 0) & x.isin(*_HARMONIC))
    status = F.when(F.size(v) == 0, "EMPTY_SEQUENCE").when(F.size(_noncore(v)) > 0, F.concat(F.lit("NONCORE_VOWEL:"), F.array_join(_noncore(v), ",")))
    if initial_i == "unscored":
        status = status.when(first == "ㅣ", "INITIAL_I_UNSCORED")
    triggered = status.isNull()
    status = status.when(F.size(targets) == 0, "NO_LATER_HARMONIC_TARGET").otherwise("SCORABLE")
    scorable = status == "SCORABLE"
    errors = F.size(F.filter(targets, lambda x: _rtr(x) != rtr))
    return {
        "baseline_status": status, "baseline_trigger": F.when(triggered, first), "baseline_trigger_rtr": F.when(triggered, rtr),
        "prediction_N": F.when(scorable, F.size(targets)).otherwise(0), "prediction_exceptions": F.when(scorable, errors).otherwise(0), "wordform_exception": scorable & (errors > 0),
    }


def baseline_details(wordforms: DataFrame, sequence: str = "d2l_sr", initial_i: str = "unscored") -> DataFrame:
    """Word forms with six columns of their score."""
    require_columns(wordforms, sequence)
    v = parse_sequence(F.col(sequence))
    return wordforms.select("*", *(c.alias(k) for k, c in score(v, initial_i).items()))


def _rates(prefix: str) -> dict[str, Column]:
    n, e = F.col(f"{prefix}_N"), F.col(f"{prefix}_exceptions")
    return {f"{prefix}_correct": n - e, f"{prefix}_exception_rate": F.try_divide(e, n), f"{prefix}_theta_N": theta(n), f"{prefix}_theta_rate": theta(n) / F.when(n > 0, n), f"{prefix}_TP_pass": tolerance_pass(n, e)}


def baseline_by_window(details: DataFrame, window: str = "time_window_id") -> DataFrame:
    """Exception rates of each window, of predictions and of word forms, with the tolerance test."""
    scorable = F.col("baseline_status") == "SCORABLE"
    bounds = [F.min(c).alias(c) for c in ("time_window_start", "time_window_end") if c in details.columns]
    out = details.groupBy(window).agg(
        F.count("*").alias("core_wordforms_input"), F.count_if(scorable).alias("scorable_wordforms"), F.count_if(F.col("baseline_status") == "INITIAL_I_UNSCORED").alias("initial_i_unscored_wordforms"),
        F.count_if(F.col("baseline_status") == "NO_LATER_HARMONIC_TARGET").alias("no_later_harmonic_target_wordforms"),
        F.sum("prediction_N").alias("prediction_N"), F.sum("prediction_exceptions").alias("prediction_exceptions"), F.count_if(scorable).alias("wordform_N"), F.count_if("wordform_exception").alias("wordform_exceptions"), *bounds,
    )
    return out.withColumns(_rates("prediction") | _rates("wordform"))
