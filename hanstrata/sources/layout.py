"""The order of columns in a run's files."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Columns of the files, in order.
WINDOW = ("time_window_start", "time_window_end", "time_window_id")
DIAGNOSTICS = (
    *WINDOW, "available_wordforms_before_sampling", "total_token_count_represented_before_sampling", "sampling_mode", "target_wordforms_per_window", "min_window_wordforms_for_warning", "min_window_tokens", "max_wordforms_per_window",
    "window_width_years", "window_step_years", "window_overlap_years", "time_window_is_low_n_warning", "time_window_is_eligible_for_sampling", "time_window_exclusion_reason", "selected_sample_size_for_window",
)
PAIR_DIAGNOSTICS = (
    "time_window_id", "sampled_wordforms_input", "d2l_eligible_lexical_wordforms", "unique_vowel_only_d2l_pairs", "lexical_wordforms_with_at_least_one_target", "lexical_wordforms_with_noninitial_i", "excluded_wordforms",
    "lexical_types_represented_by_weights_beyond_unique_pairs", "fraction_lexical_types_collapsed_structurally", "fraction_sample_excluded_from_core_inventory",
)
_RATES = ("N", "correct", "exceptions", "exception_rate", "theta_N", "theta_rate", "TP_pass")
BASELINE = (
    "time_window_id", "core_wordforms_input", "scorable_wordforms", "initial_i_unscored_wordforms", "no_later_harmonic_target_wordforms",
    *(f"prediction_{c}" for c in _RATES), *(f"wordform_{c}" for c in _RATES), "time_window_start", "time_window_end",
)
RESULTS = (
    "time_window_id", "time_window_start", "time_window_end", "status", "lexical_wordforms_represented", "unique_structural_pairs", "learned_rule", "learned_harmony_type", "learned_direction", "learned_tier", "tier_was_induced",
    "tier_included_surface_segments", "tier_excluded_surface_segments", "d2l_prediction_N", "d2l_prediction_correct", "d2l_prediction_exceptions", "d2l_exception_rate", "d2l_theta_N", "d2l_theta_rate", "d2l_TP_pass",
    "weighted_prediction_accuracy", "weighted_full_form_accuracy", "declared_weighted_target_count",
)
TRACE = ("branch", "attempt_depth", "tier_before", "delset_before", "target_segments", "left_contexts", "right_contexts", "selected_direction", "selected_prediction_N", "selected_prediction_correct", "selected_prediction_exceptions", "selected_accuracy", "theta_N", "TP_pass")


def in_order(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    """The columns of df: first those of `names` that it has, in their order, then the others."""
    first = [c for c in names if c in df.columns]
    return first + [c for c in df.columns if c not in first]
