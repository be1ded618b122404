"""Stage 03: token rows to a sample of word forms for each time window."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hanstrata.functions.text import WHITE, strip
from hanstrata.runtime import checkpoint, require_columns


@dataclass(frozen=True)
class Sampling:
    """Settings of the sampling."""

    year_col: str = "year"
    token_col: str = "token"
    vowels_col: str = "vowels"
    window_width: int = 100
    window_step: int = 50
    start_year: int | None = 1443
    min_word_vowels: int = 2
    max_word_vowels: int | None = 5
    sampling_mode: str = "cap-preserve-windows"
    target_wordforms_per_window: int = 1000
    min_window_wordforms: int = 1000
    min_window_tokens: int = 0
    max_wordforms_per_window: int | None = None
    exclude_windows: tuple[str, ...] | None = ()

    def __post_init__(self):
        if self.window_width <= 0 or self.window_step <= 0:
            raise ValueError("window_width and window_step are positive")
        if self.sampling_mode not in ("cap-preserve-windows", "strict-balanced"):
            raise ValueError(f"unknown sampling_mode {self.sampling_mode!r}")
        if self.min_word_vowels < 1 or (self.max_word_vowels is not None and self.max_word_vowels < self.min_word_vowels):
            raise ValueError("vowel bounds are positive and in order")
        if self.target_wordforms_per_window <= 0 or (self.max_wordforms_per_window is not None and self.max_wordforms_per_window <= 0):
            raise ValueError("sample sizes are positive")


def _year(c: Column) -> Column:
    number = c.try_cast("double")
    return F.when(~F.isnan(number), number)


def anchor_year(rows: DataFrame, settings: Sampling) -> int:
    """Where windows start: the set year, else the least year of all rows, down to a multiple of the step."""
    if settings.start_year is not None:
        return settings.start_year
    least = rows.agg(F.floor(F.min(_year(F.col(settings.year_col))))).first()[0]
    if least is None:
        raise ValueError("there is no usable year")
    return int(least) - int(least) % settings.window_step


def year_windows(year: Column, anchor: int, width: int, step: int) -> Column:
    """array of struct(start, end): all windows that hold a year, ascending; none before the anchor or in gaps."""
    latest = F.lit(anchor) + F.floor((year - anchor) / step).cast("int") * step
    back = -(-width // step) - 1
    starts = F.transform(F.sequence(F.lit(-back), F.lit(0)), lambda k: latest + k * step)
    held = F.filter(starts, lambda s: (s >= anchor) & (s + (width - 1) >= year))
    return F.transform(held, lambda s: F.struct(s.cast("int").alias("start"), (s + (width - 1)).cast("int").alias("end")))


def parse_vowels(c: Column) -> Column:
    """The parts of a comma-joined sequence, without white space around them and without empty ones."""
    return F.filter(F.split(strip(F.regexp_replace(c, f"[{WHITE}]*,[{WHITE}]*", ",")), ","), lambda v: v != "")


def clean_rows(rows: DataFrame, settings: Sampling) -> DataFrame:
    """Rows that count, with year cut to a whole number, token trimmed, vowel_seq and num_vowels_normalized."""
    year = _year(F.col(settings.year_col))
    rows = rows.withColumns({"_y": year, "_t": strip(F.col(settings.token_col)), "_v": parse_vowels(F.col(settings.vowels_col))})
    keep = F.col("_y").isNotNull() & (F.col("_t") != "") & (F.size("_v") >= settings.min_word_vowels)
    if settings.start_year is not None:
        keep = keep & (F.col("_y") >= settings.start_year)
    if settings.max_word_vowels is not None:
        keep = keep & (F.size("_v") <= settings.max_word_vowels)
    rows = rows.where(keep).withColumns({settings.year_col: F.col("_y").cast("int"), settings.token_col: F.col("_t"), "vowel_seq": F.array_join("_v", " "), "num_vowels_normalized": F.size("_v")})
    return rows.withColumn("wordform_id", F.concat(F.col(settings.token_col), F.lit(" || "), F.col("vowel_seq"))).drop("_y", "_t", "_v")


def _windowed(rows: DataFrame, settings: Sampling, anchor: int) -> DataFrame:
    window = F.explode(year_windows(F.col(settings.year_col), anchor, settings.window_width, settings.window_step))
    rows = rows.withColumn("_w", window).withColumns({"time_window_start": F.col("_w.start"), "time_window_end": F.col("_w.end")}).drop("_w")
    return rows.withColumn("time_window_id", F.concat_ws("-", "time_window_start", "time_window_end"))


CLASSES = ("vowel_classes_core", "harmony_status_core", "vowel_classes_expanded", "harmony_status_expanded")


def count_wordforms(rows: DataFrame, settings: Sampling = Sampling(), anchor: int | None = None) -> DataFrame:
    """Counts of each word form in each window.

    Rows are counted by year first, and only these counts are repeated for the windows that hold
    the year; the largest shuffle is by word form and year, never by window.
    """
    require_columns(rows, settings.year_col, settings.token_col, settings.vowels_col, "token_source", *CLASSES)
    anchor = anchor_year(rows, settings) if anchor is None else anchor
    keys = ["wordform_id", settings.token_col, "vowel_seq", "num_vowels_normalized"]
    source = F.coalesce(F.col("token_source"), F.lit("nan"))
    by_year = clean_rows(rows, settings).groupBy(*keys, settings.year_col).agg(F.count("*").alias("n"), F.collect_set(source).alias("sources"), *(F.min(c).alias(c) for c in CLASSES))
    windowed = _windowed(by_year, settings, anchor)
    counted = windowed.groupBy("time_window_start", "time_window_end", "time_window_id", *keys).agg(
        F.sum("n").alias("token_count_in_window"), F.min(settings.year_col).alias("first_observed_year_in_window"), F.max(settings.year_col).alias("last_observed_year_in_window"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("_s"), *(F.min(c).alias(c) for c in CLASSES),
    )
    return counted.select(
        "time_window_start", "time_window_end", "time_window_id", "wordform_id", settings.token_col, "vowel_seq", "token_count_in_window", "first_observed_year_in_window", "last_observed_year_in_window",
        "num_vowels_normalized", F.array_join("_s", "|").alias("token_sources_present"), F.exists("_s", lambda s: F.lower(s).contains("idu")).alias("contains_idu_derived_observation"), *CLASSES,
    )


def window_diagnostics(wordforms: DataFrame, settings: Sampling = Sampling()) -> DataFrame:
    """One row for each window: what it holds, and whether and why it enters the sample."""
    out = wordforms.groupBy("time_window_start", "time_window_end", "time_window_id").agg(
        F.count("wordform_id").alias("available_wordforms_before_sampling"), F.sum("token_count_in_window").alias("total_token_count_represented_before_sampling")
    )
    few = F.col("available_wordforms_before_sampling") < settings.min_window_wordforms
    strict = F.lit(settings.sampling_mode == "strict-balanced")
    poor = F.col("total_token_count_represented_before_sampling") < settings.min_window_tokens
    manual = F.col("time_window_id").isin(*(settings.exclude_windows or ())) if settings.exclude_windows else F.lit(False)
    reason = F.when(manual, "MANUALLY_EXCLUDED").when(poor, "BELOW_MIN_TOKENS").when(strict & few, "BELOW_MIN_WORDFORMS").otherwise("INCLUDED")
    constants = {
        "sampling_mode": settings.sampling_mode, "target_wordforms_per_window": settings.target_wordforms_per_window, "min_window_wordforms_for_warning": settings.min_window_wordforms, "min_window_tokens": settings.min_window_tokens,
        "max_wordforms_per_window": settings.max_wordforms_per_window, "window_width_years": settings.window_width, "window_step_years": settings.window_step, "window_overlap_years": max(0, settings.window_width - settings.window_step),
    }
    out = out.withColumns({k: F.lit(v).cast("string" if isinstance(v, str) else "int") for k, v in constants.items()})
    return out.withColumns({"time_window_is_low_n_warning": few, "time_window_is_eligible_for_sampling": reason == "INCLUDED", "time_window_exclusion_reason": reason})


def with_sample_sizes(diagnostics: DataFrame, settings: Sampling = Sampling()) -> DataFrame:
    """Diagnostics with selected_sample_size_for_window; raises if no window is eligible.

    In strict mode all windows get what the smallest eligible one has: one small job over windows.
    """
    available, eligible = F.col("available_wordforms_before_sampling"), F.col("time_window_is_eligible_for_sampling")
    return diagnostics.withColumn("selected_sample_size_for_window", F.when(eligible, F.least(available, F.lit(_sample_size(diagnostics, settings)))).otherwise(0).cast("int"))


def _sample_size(diagnostics: DataFrame, settings: Sampling) -> int:
    least = diagnostics.where("time_window_is_eligible_for_sampling").agg(F.min("available_wordforms_before_sampling")).first()[0]
    if least is None:
        raise ValueError("no time window is eligible for sampling")
    n = int(least) if settings.sampling_mode == "strict-balanced" else settings.target_wordforms_per_window
    return min(n, settings.max_wordforms_per_window) if settings.max_wordforms_per_window is not None else n


def select_wordforms(wordforms: DataFrame, diagnostics: DataFrame, settings: Sampling = Sampling()) -> DataFrame:
    """The most frequent word forms of each eligible window, ranked from 1.

    The sample size is a literal of the plan, so that ranks beyond it are cut before the shuffle.
    """
    size = _sample_size(diagnostics, settings)
    few = ["time_window_id", "time_window_is_eligible_for_sampling", "time_window_is_low_n_warning", "time_window_exclusion_reason", "sampling_mode", "target_wordforms_per_window"]
    order = W.partitionBy("time_window_id").orderBy(F.desc("token_count_in_window"), "first_observed_year_in_window", settings.token_col, "vowel_seq")
    ranked = wordforms.withColumn("frequency_rank_in_window", F.row_number().over(order)).where(F.col("frequency_rank_in_window") <= size)
    windows = diagnostics.where("time_window_is_eligible_for_sampling").select(*few, F.least("available_wordforms_before_sampling", F.lit(size)).cast("int").alias("selected_sample_size_for_window"))
    return ranked.join(windows, "time_window_id").withColumn("sample_size_per_time_window", F.col("selected_sample_size_for_window"))


def excluded_windows(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.where("not time_window_is_eligible_for_sampling")


#: Sampled word forms up to which a sample is sent to every task: some ten megabytes.
SENT_WORDFORMS = 200_000


def selected_token_rows(rows: DataFrame, selected: DataFrame, settings: Sampling = Sampling(), anchor: int | None = None) -> DataFrame:
    """The token rows behind a sample, once for each window that they are sampled in.

    A sample holds some word forms of each window. It is counted: up to SENT_WORDFORMS of them go to
    every task, and rows of other word forms leave before they are repeated for their windows. A
    larger sample is joined by shuffle, where the engine splits the word forms that own most rows.
    """
    anchor = anchor_year(rows, settings) if anchor is None else anchor
    keys = checkpoint(selected.select("time_window_id", "wordform_id"))
    send = F.broadcast if keys.count() <= SENT_WORDFORMS else (lambda df: df)
    kept = clean_rows(rows, settings).join(send(keys.select("wordform_id").distinct()), "wordform_id", "left_semi")
    return _windowed(kept, settings, anchor).join(send(keys), ["time_window_id", "wordform_id"], "left_semi")
