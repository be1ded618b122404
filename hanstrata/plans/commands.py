"""The stages as commands: each reads files, takes settings from a file and from flags, and writes files.

    python -m hanstrata STAGE INPUT OUTPUT [--config FILE] [--setting value ...]

A run's folder is the OUTPUT of `sample`, and INPUT and OUTPUT of the stages that follow.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hanstrata.operators import language_id, learning, pairs, sampling, tokens
from hanstrata.operators.documents import ALL_LABELS, RECORD_LABELS
from hanstrata.operators.lexicon import Lexicon, find_resource
from hanstrata.plans.pipeline import write_in_order
from hanstrata.plans.pipeline import preprocess as preprocess_files
from hanstrata.runtime import checkpoint, ship
from hanstrata.sources import config, files, layout

SAMPLE, SAMPLE_ROWS = "sampled_time_window_wordforms", "sampled_time_window_original_token_rows"


def _echo(spark: SparkSession, settings, path: str, **derived) -> None:
    files.write_text(spark, config.as_json(settings, **derived), path)


def preprocess(spark: SparkSession, source: str, target: str, settings: config.Preprocessing, model: str | None = None) -> dict:
    """Stage 01: JSON lines to processed documents, each file in its own place. `model` is a file of language_id.Letters."""
    own = language_id.saved(model) if model else None
    known = language_id.Letters.load(model).labels if model else []
    among = lambda labels: language_id.identify(own, tuple(x for x in labels if x in known)) if own else None
    settings = replace(settings, input_dir=source, output_dir=target)
    _, counts = preprocess_files(spark, settings, identify=among(ALL_LABELS), identify_records=among(RECORD_LABELS))
    _echo(spark, settings, f"{target}/preprocessing_config.json", **counts)
    return counts


def _processed(spark: SparkSession, source: str) -> DataFrame:
    docs = spark.read.schema(files.PROCESSED).option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").json(source).withColumn("input_file", F.input_file_name())
    return docs.withColumnsRenamed({f"script.{k}": f"script_{k}" for k in ("kor", "oko", "jpn", "han", "lat")})


def extract(spark: SparkSession, source: str, target: str, settings: tokens.Extraction, dictionary: str | None = None, general_exclusions: str | None = None, noun_exclusions: str | None = None) -> dict:
    """Stage 02: processed documents to token rows, as Parquet. Resources are looked for in the usual folders, too."""
    found = [None if p is None else find_resource(p) or p for p in (dictionary, general_exclusions, noun_exclusions)]
    lexicon = Lexicon.load(*found) if dictionary else None
    docs = _processed(spark, source)
    tokens.token_rows(docs, settings, lexicon).write.mode("overwrite").parquet(f"{target}/token_rows")
    counts = tokens.counts(docs, settings, lexicon).first().asDict()
    _echo(spark, settings, f"{target}/extraction_config.json", **counts)
    return counts


def sample(spark: SparkSession, source: str, target: str, settings: sampling.Sampling, write_token_rows: bool = True) -> dict:
    """Stage 03: token rows (a folder of Parquet, or of CSV if its name ends so) to the sample of each window."""
    rows = files.read_csv(spark, source, [settings.year_col, settings.token_col, settings.vowels_col]) if source.endswith(".csv") else spark.read.parquet(f"{source}/token_rows")
    anchor = sampling.anchor_year(rows, settings)
    counted = checkpoint(sampling.count_wordforms(rows, settings, anchor))
    diagnostics = sampling.window_diagnostics(counted, settings)
    chosen = checkpoint(sampling.select_wordforms(counted, diagnostics, settings))
    files.write_csv(chosen, f"{target}/{SAMPLE}", order=["time_window_start", "frequency_rank_in_window"])
    write_in_order(sampling.with_sample_sizes(diagnostics, settings), f"{target}/time_window_diagnostics", layout.DIAGNOSTICS, order=["time_window_start"])
    write_in_order(sampling.with_sample_sizes(diagnostics, settings).where("not time_window_is_eligible_for_sampling"), f"{target}/excluded_time_windows", layout.DIAGNOSTICS, order=["time_window_start"])
    if write_token_rows:
        files.write_csv(sampling.selected_token_rows(rows, chosen, settings, anchor), f"{target}/{SAMPLE_ROWS}")
    _echo(spark, settings, f"{target}/sampling_config.json", anchor_year=anchor)
    return {"anchor_year": anchor, "sampled_wordforms": chosen.count()}


def _typed(df: DataFrame, **kinds: str) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in kinds.items() if c in df.columns})


def pair(spark: SparkSession, source: str, target: str, settings: config.Pairs) -> dict:
    """Stage 07: the sample to weighted pairs. Raises ValueError if no word form can be converted."""
    rows = _typed(files.read_csv(spark, f"{source}/{SAMPLE}", [settings.window_id_col, settings.vowel_seq_col]), frequency_rank_in_window="int", time_window_start="int", time_window_end="int")
    eligible, excluded = pairs.convert(rows, settings.window_id_col, settings.vowel_seq_col, settings.min_vowels)
    eligible = checkpoint(eligible)
    if not (n := eligible.count()):
        raise ValueError("no word form of the sample can be converted to a pair")
    weighted, folder = pairs.weighted_pairs(eligible, settings.window_id_col, settings.wordform_id_col, settings.token_col), f"{target}/d2l_core"
    files.write_csv(eligible, f"{folder}/d2l_wordforms")
    files.write_csv(excluded, f"{folder}/d2l_excluded_wordforms")
    files.write_csv(weighted, f"{folder}/d2l_weighted_pairs")
    write_in_order(pairs.pair_diagnostics(rows, settings.window_id_col, settings.vowel_seq_col, settings.min_vowels), f"{folder}/d2l_window_diagnostics", layout.PAIR_DIAGNOSTICS)
    if settings.write_window_pair_files:
        files.write_window_pairs(weighted, f"{folder}/window_pairs", settings.window_id_col)
    _echo(spark, settings, f"{folder}/d2l_input_config.json", eligible_wordforms=n)
    return {"eligible_wordforms": n}


BASELINE_CHARTS = ("prediction_exception_rate", "wordform_exception_rate", "scorable_wordforms")
LEARNING_CHARTS = ("harmony_initial_exception_rate", "baseline_prediction_exception_rate")


def baseline(spark: SparkSession, source: str, target: str, settings: config.Baseline) -> dict:
    """Stage 09: exception rates of each window, and charts where they can be drawn into a local folder."""
    rows = _typed(files.read_csv(spark, f"{source}/d2l_core/d2l_wordforms", [settings.window_id_col, settings.vowel_seq_col]), time_window_start="int", time_window_end="int")
    details = pairs.baseline_details(rows, settings.vowel_seq_col, settings.initial_i_policy)
    summary, folder = checkpoint(pairs.baseline_by_window(details, settings.window_id_col)), f"{target}/baseline"
    write_in_order(summary, f"{folder}/baseline_exception_rate_by_window", layout.BASELINE, order=["time_window_start", settings.window_id_col])
    if settings.write_wordform_details:
        files.write_csv(details, f"{folder}/baseline_wordform_details")
    drawn = files.line_charts(summary, folder, BASELINE_CHARTS) if "://" not in target else []
    _echo(spark, settings, f"{folder}/baseline_analysis_config.json")
    return {"windows": summary.count(), "charts": len(drawn)}


def learn(spark: SparkSession, source: str, target: str, settings: config.Learning, features: str | None = None) -> dict:
    """Stage 10: the learner on each window's pairs, its failures, and the baseline beside it if there is one."""
    window, folder = settings.window_id_col, f"{target}/d2l_results"
    rows = _typed(files.read_csv(spark, f"{source}/d2l_core/d2l_weighted_pairs", [window, settings.ur_col, settings.sr_col, settings.weight_col]), **{settings.weight_col: "int"})
    learned = checkpoint(learning.learn(rows, window, settings.mode, settings.ur_col, settings.sr_col, settings.weight_col, files.read_features(features) if features else None))
    contexts = checkpoint(learning.failure_contexts(learning.exploded(learned, "events", window), window))
    there = f"{source}/baseline/baseline_exception_rate_by_window"
    base = files.read_csv(spark, there, [window]) if files.exists(spark, f"{there}/_SUCCESS") else None
    summary = learning.with_baseline(learning.results(learned), base, window).join(learning.top_contexts(contexts, window), window, "left")
    write_in_order(summary, f"{folder}/d2l_results_by_window", layout.RESULTS, order=["time_window_start", window])
    write_in_order(learning.exploded(learned, "trace", window), f"{folder}/d2l_learning_trace", layout.TRACE)
    files.write_csv(learning.exploded(learned, "events", window), f"{folder}/d2l_failed_predictions")
    if settings.write_pair_predictions:
        files.write_csv(learning.exploded(learned, "predictions", window), f"{folder}/d2l_pair_predictions")
    files.write_csv(contexts, f"{folder}/d2l_failure_context_summary", order=[window, "branch", "attempt_depth", "failure_rank_within_candidate", "context_segment", "context_source"])
    files.write_csv(learning.initial_harmony(contexts), f"{folder}/d2l_initial_harmony_failure_context_summary")
    files.write_csv(learning.failure_targets(learning.exploded(learned, "events", window), window), f"{folder}/d2l_failure_target_summary")
    if base is not None and "://" not in target:
        files.line_charts(_typed(summary, **dict.fromkeys(LEARNING_CHARTS, "double")), folder, LEARNING_CHARTS)
    _echo(spark, settings, f"{folder}/d2l_run_config.json")
    return {"windows": learned.count()}


#: Each stage: its function, its settings, and the options that are no settings.
STAGES: dict[str, tuple[Callable, type, tuple[str, ...]]] = {
    "preprocess": (preprocess, config.Preprocessing, ("model",)), "extract": (extract, tokens.Extraction, ("dictionary", "general_exclusions", "noun_exclusions")), "sample": (sample, sampling.Sampling, ()),
    "pair": (pair, config.Pairs, ()), "baseline": (baseline, config.Baseline, ()), "learn": (learn, config.Learning, ("features",)),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Runs one stage; prints and gives its counts. ValueError for anything but the form above."""
    argv = list(sys.argv[1:] if argv is None else argv)
    if len(argv) < 3 or argv[0] not in STAGES:
        raise ValueError(f"usage: python -m hanstrata {{{','.join(STAGES)}}} INPUT OUTPUT [--config FILE] [--setting value ...]")
    stage, source, target, *rest = argv
    run, kind, more = STAGES[stage]
    options = {}
    for name in more:
        flag = "--" + name.replace("_", "-")
        if flag in rest:
            at = rest.index(flag)
            options[name] = rest[at + 1]
            del rest[at : at + 2]
    settings = config.from_command_line(kind, rest)
    own = spark or SparkSession.builder.appName(f"hanstrata {stage}").getOrCreate()
    ship(own)
    counts = run(own, source.rstrip("/"), target.rstrip("/"), settings, **options)
    print(stage, *(f"{k}={v}" for k, v in counts.items()))
    return counts
