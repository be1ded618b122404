"""Stage 10: the learner on each window's pairs, and summaries of its failures."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hanstrata.operators import learner as L
from hanstrata.runtime import require_columns

_TEXT, _COUNT, _SHARE, _FLAG = "string", "bigint", "double", "boolean"
TRACE = {
    "branch": _TEXT, "attempt_depth": "int", "tier_before": _TEXT, "delset_before": _TEXT, "target_segments": _TEXT, "left_contexts": _TEXT, "right_contexts": _TEXT, "selected_direction": _TEXT,
    "selected_prediction_N": _COUNT, "selected_prediction_correct": _COUNT, "selected_prediction_exceptions": _COUNT, "selected_accuracy": _SHARE, "theta_N": _SHARE, "TP_pass": _FLAG, "default": _TEXT,
    "all_errant_contexts": _TEXT, "eligible_errant_contexts": _TEXT, "new_delset_segments": _TEXT, "delset_after": _TEXT, "tier_candidate_type": _TEXT, "tier_after": _TEXT, "natural_class_options": _TEXT, "chosen_natural_class": _TEXT, "terminal_status": _TEXT,
}
EVENTS = {
    "d2l_ur": _TEXT, "d2l_sr": _TEXT, "lexical_type_weight": _COUNT, "direction": _TEXT, "harmony_type": _TEXT, "tier": _TEXT, "target_index": "int", "target_abstract_segment": _TEXT, "actual_surface_segment": _TEXT, "predicted_surface_segment": _TEXT,
    "correct": _FLAG, "weighted_count": _COUNT, "context_segment": _TEXT, "context_index": "int", "context_source": _TEXT, "original_context_symbol": _TEXT, "context_was_resolved_target": _FLAG, "previous_target_prediction_correct": _FLAG,
    "context_was_prior_misprediction": _FLAG, "used_rule_context": _FLAG, "used_default": _FLAG, "context_is_protected_abstract_target": _FLAG, "context_is_protected_initial_position": _FLAG, "context_is_boundary": _FLAG,
    "eligible_for_delset_under_current_rule": _FLAG, "branch": _TEXT, "attempt_depth": "int", "candidate_direction": _TEXT, "selected_candidate": _FLAG,
}
PREDICTIONS = {
    "d2l_ur": _TEXT, "d2l_sr": _TEXT, "predicted_sr": _TEXT, "lexical_type_weight": _COUNT, "pair_full_form_correct": _FLAG, "prediction_N_per_lexical_type": _COUNT, "prediction_correct_per_lexical_type": _COUNT,
    "prediction_exceptions_per_lexical_type": _COUNT, "weighted_prediction_N": _COUNT, "weighted_prediction_correct": _COUNT, "weighted_prediction_exceptions": _COUNT,
}
SUMMARY = {
    "status": _TEXT, "error_type": _TEXT, "error_message": _TEXT, "lexical_wordforms_represented": _COUNT, "unique_structural_pairs": _COUNT, "declared_weighted_target_count": _COUNT, "learned_rule": _TEXT, "learned_harmony_type": _TEXT,
    "learned_direction": _TEXT, "learned_tier": _TEXT, "tier_was_induced": _FLAG, "tier_included_surface_segments": _TEXT, "tier_excluded_surface_segments": _TEXT, "d2l_prediction_N": _COUNT, "d2l_prediction_correct": _COUNT,
    "d2l_prediction_exceptions": _COUNT, "d2l_exception_rate": _SHARE, "d2l_theta_N": _SHARE, "d2l_theta_rate": _SHARE, "d2l_TP_pass": _FLAG, "weighted_prediction_accuracy": _SHARE, "weighted_full_form_accuracy": _SHARE,
}


def _struct(columns: dict[str, str]) -> str:
    return "array<struct<" + ",".join(f"{k}:{t}" for k, t in columns.items()) + ">>"


def window_bounds(c: Column) -> tuple[Column, Column]:
    """Start and end of a window's id `start-end`; nulls where it is not of this form."""
    parts = F.split(c, "-", 2)
    start, end = (F.try_element_at(parts, F.lit(k)).try_cast("int") for k in (1, 2))
    return F.when(end.isNotNull(), start), F.when(start.isNotNull(), end)


def learn(pairs: DataFrame, window: str = "time_window_id", mode: str = "progressive", ur: str = "d2l_ur", sr: str = "d2l_sr", weight: str = "lexical_type_weight", features: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """One row for each window: the learned rule and its figures, and arrays `trace`, `events` and `predictions`.

    `features` are those of sources.files.read_features(); without them, the core inventory's.

    Equal pairs of a window are added up before they go to the learner, which gets one row for
    each structure of the window's word forms: a few hundred, however many tokens the window has.
    """
    require_columns(pairs, window, ur, sr, weight)
    if mode not in ("progressive", "bidirectional"):
        raise ValueError("mode is progressive or bidirectional")
    fit = L.learn_progressive if mode == "progressive" else L.learn_bidirectional
    inventory = L.Inventory(features) if features else L.CORE
    distinct = pairs.groupBy(F.col(window).alias("window"), F.col(ur).alias("ur"), F.col(sr).alias("sr")).agg(F.sum(weight).alias("weight"), F.min(weight).alias("least"))
    # learning takes long for few bytes, so windows must not be put together by size
    distinct = distinct.repartition(8 * pairs.sparkSession.sparkContext.defaultParallelism, "window")

    def one(table: pa.Table) -> pa.Table:
        group = table.to_pandas()
        row = {"window": group["window"].iloc[0], "lexical_wordforms_represented": int(group["weight"].sum()), "unique_structural_pairs": len(group), "d2l_TP_pass": False, "tier_was_induced": False, "trace": [], "events": [], "predictions": []}
        try:
            if group["least"].min() <= 0:
                raise ValueError(f"weights are positive; there is {group['least'].min()}")
            merged = L.merged(group[["ur", "sr", "weight"]].itertuples(index=False))
            targets = sum(w * sum(s in L.V.TARGET_PAIRS for s in u[1:]) for (u, _), w in merged.items())
            row["declared_weighted_target_count"] = targets
            if not targets:
                return made(row | {"status": "NO_D2L_TARGETS"})
            found = fit(merged, inventory)
        except Exception as error:  # a window that can't be learned from is reported, not fatal
            return made(row | {"status": "ERROR", "error_type": type(error).__name__, "error_message": str(error)})
        row |= {"trace": [{k: t.get(k) for k in TRACE} for t in found.trace], "events": [{k: e.get(k) for k in EVENTS} for e in found.events], "status": "NO_PRODUCTIVE_RULE"}
        if found.rule is not None:
            n, m = found.rule.counts(merged)
            on, off = L.surface_on_tier(found.rule)
            theta = L.tolerance(n)
            row |= {
                "status": "RULE_LEARNED" if L.productive(n, m) else "RULE_RETURNED_BUT_TP_FAILED", "learned_rule": str(found.rule), "learned_harmony_type": "harmony" if found.rule.harmony else "disharmony", "learned_direction": found.rule.direction,
                "learned_tier": found.rule.tier.name if found.rule.tier else "NONE", "tier_was_induced": found.rule.tier is not None, "tier_included_surface_segments": on, "tier_excluded_surface_segments": off,
                "d2l_prediction_N": n, "d2l_prediction_correct": m, "d2l_prediction_exceptions": n - m, "d2l_exception_rate": (n - m) / n if n else None, "d2l_theta_N": theta, "d2l_theta_rate": theta / n if theta else None, "d2l_TP_pass": L.productive(n, m),
                "weighted_prediction_accuracy": m / n if n else None, "weighted_full_form_accuracy": L.full_form_accuracy(found.rule, merged), "predictions": L.pair_predictions(found.rule, merged),
            }
        return made(row)

    kind = dict(pairs.dtypes)[window]
    schema = f"window {kind}, " + ", ".join(f"{k} {t}" for k, t in SUMMARY.items()) + f", trace {_struct(TRACE)}, events {_struct(EVENTS)}, predictions {_struct(PREDICTIONS)}"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def made(row: dict) -> pa.Table:
        return pa.Table.from_pylist([{k: row.get(k) for k in arrow.names}], schema=arrow)

    start, end = window_bounds(F.col(window).cast("string"))
    return distinct.groupBy("window").applyInArrow(one, schema).withColumnRenamed("window", window).withColumns({"time_window_start": start, "time_window_end": end})


def _of(branch: str):
    return lambda step: step["branch"] == branch


def results(learned: DataFrame) -> DataFrame:
    """The learner's figures for each window, with first and last step of each branch."""
    fields = {}
    for branch in ("harmony", "disharmony"):
        steps = F.filter("trace", _of(branch))
        first, last = F.try_element_at(steps, F.lit(1)), F.try_element_at(steps, F.lit(-1))
        fields[f"{branch}_num_attempts"] = F.size(steps)
        fields |= {f"{branch}_initial_{k}": first[c] for k, c in {"direction": "selected_direction", "prediction_N": "selected_prediction_N", "prediction_correct": "selected_prediction_correct", "prediction_exceptions": "selected_prediction_exceptions", "theta_N": "theta_N", "TP_pass": "TP_pass"}.items()}
        fields[f"{branch}_initial_exception_rate"] = F.try_divide(first["selected_prediction_exceptions"], first["selected_prediction_N"])
        fields |= {f"{branch}_terminal_{k}": last[c] for k, c in {"status": "terminal_status", "tier": "tier_after", "delset": "delset_after", "prediction_N": "selected_prediction_N", "prediction_exceptions": "selected_prediction_exceptions", "TP_pass": "TP_pass"}.items()}
    return learned.withColumns(fields).drop("trace", "events", "predictions")


def exploded(learned: DataFrame, what: str, window: str = "time_window_id") -> DataFrame:
    """The rows of `trace`, `events` or `predictions`."""
    return learned.select(window, F.explode(what).alias("_r")).select(window, "_r.*")


_CANDIDATE = ["branch", "attempt_depth", "candidate_direction", "selected_candidate"]


def failure_contexts(events: DataFrame, window: str = "time_window_id") -> DataFrame:
    """Failed predictions of each candidate by context: counts, weights, share and dense rank."""
    by = [window, *_CANDIDATE]
    weight = F.col("weighted_count")
    part = lambda c: F.sum(F.when(c, weight).otherwise(0))
    eligible = F.col("eligible_for_delset_under_current_rule")
    out = events.groupBy(*by, "context_segment", "context_source").agg(
        F.count("*").alias("structural_failed_predictions"), F.sum(weight).alias("weighted_failed_predictions"), part(eligible).alias("weighted_eligible_for_delset"), part(~eligible).alias("weighted_ineligible_for_delset"),
        part(F.col("context_was_prior_misprediction")).alias("weighted_errors_after_prior_misprediction"), part(F.col("used_default")).alias("weighted_default_errors"),
        part(F.col("context_is_protected_initial_position")).alias("weighted_protected_initial_context_errors"),
    )
    candidate = W.partitionBy(*by)
    return out.withColumns({
        "share_of_weighted_failures": F.try_divide(F.col("weighted_failed_predictions"), F.sum("weighted_failed_predictions").over(candidate)),
        "failure_rank_within_candidate": F.dense_rank().over(candidate.orderBy(F.desc("weighted_failed_predictions"))),
    })


def failure_targets(events: DataFrame, window: str = "time_window_id") -> DataFrame:
    """Failed predictions of each candidate by target and outcome."""
    keys = [window, *_CANDIDATE, "target_abstract_segment", "actual_surface_segment", "predicted_surface_segment"]
    return events.groupBy(*keys).agg(F.count("*").alias("structural_failed_predictions"), F.sum("weighted_count").alias("weighted_failed_predictions"))


def initial_harmony(contexts: DataFrame) -> DataFrame:
    """Contexts of the selected harmony candidate before any tier."""
    return contexts.where((F.col("branch") == "harmony") & (F.col("attempt_depth") == 0) & F.col("selected_candidate"))


def top_contexts(contexts: DataFrame, window: str = "time_window_id", n: int = 5) -> DataFrame:
    """(window, initial_harmony_top_error_contexts): `segment:weight; ...` of the n weightiest; ties by segment and source."""
    place = F.row_number().over(W.partitionBy(window).orderBy(F.desc("weighted_failed_predictions"), "context_segment", "context_source"))
    top = initial_harmony(contexts).withColumn("_p", place).where(F.col("_p") <= n)
    text = F.concat_ws(":", "context_segment", "weighted_failed_predictions")
    return top.groupBy(window).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", text.alias("x")))), lambda s: s["x"]), "; ").alias("initial_harmony_top_error_contexts"))


BASELINE = (
    "prediction_N", "prediction_exceptions", "prediction_exception_rate", "prediction_theta_N", "prediction_theta_rate", "prediction_TP_pass", "wordform_N", "wordform_exceptions", "wordform_exception_rate", "wordform_theta_N",
    "wordform_theta_rate", "wordform_TP_pass", "scorable_wordforms", "initial_i_unscored_wordforms", "no_later_harmonic_target_wordforms",
)


def with_baseline(summary: DataFrame, baseline: DataFrame | None, window: str = "time_window_id") -> DataFrame:
    """The summary with the baseline's figures as baseline_...; unchanged without a baseline.

    The two belong together one to one: a window that occurs twice on either side fails the job that
    reads the result, with an error that names it.
    """
    if baseline is None:
        return summary
    require_columns(baseline, window)
    columns = [F.col(c).alias(f"baseline_{c}") for c in BASELINE if c in baseline.columns]
    packed = baseline.groupBy(window).agg(F.count("*").alias("_m"), F.first(F.struct(*columns)).alias("_b"))
    joined = summary.withColumn("_n", F.count("*").over(W.partitionBy(window))).join(packed, window, "left")
    twice = (F.col("_n") > 1) | F.coalesce(F.col("_m") > 1, F.lit(False))
    row = F.when(twice, F.raise_error(F.concat(F.lit(f"{window} occurs more than once: "), F.col(window).cast("string")))).otherwise(F.col("_b"))
    # the check is a part of every column, so that none can be read without it
    return joined.withColumn("_r", row).select(*(F.col(c) for c in summary.columns), *(F.col(f"_r.baseline_{c}") for c in BASELINE if c in baseline.columns))
