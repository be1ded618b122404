"""The stages, composed: each takes and gives DataFrames, or reads and writes their files."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

from hanstrata.operators import documents, learning, pairs, sampling, tokens
from hanstrata.operators.lexicon import Lexicon
from hanstrata.runtime import checkpoint
from hanstrata.sources import config, files, layout


def write_in_order(df: DataFrame, path: str, names: tuple[str, ...], order=()) -> None:
    files.write_csv(df, path, layout.in_order(df, names), order)


@dataclass
class Analysis:
    """All stages over raw documents. Each attribute is a lazy DataFrame, but for what a stage needs as a number.

    Word form counts are used by three later steps and written to the shared folder once.
    """

    raw: DataFrame
    extraction: tokens.Extraction = field(default_factory=tokens.Extraction)
    sampling: sampling.Sampling = field(default_factory=sampling.Sampling)
    pairing: config.Pairs = field(default_factory=config.Pairs)
    lexicon: Lexicon | None = None
    mode: str = "progressive"
    initial_i: str = "unscored"

    @cached_property
    def processed(self) -> DataFrame:
        return documents.classify(documents.profile(self.raw))

    @cached_property
    def token_rows(self) -> DataFrame:
        return tokens.token_rows(self.processed, self.extraction, self.lexicon)

    @cached_property
    def wordforms(self) -> DataFrame:
        return checkpoint(sampling.count_wordforms(self.token_rows, self.sampling))

    @cached_property
    def diagnostics(self) -> DataFrame:
        return sampling.window_diagnostics(self.wordforms, self.sampling)

    @cached_property
    def sample(self) -> DataFrame:
        return sampling.select_wordforms(self.wordforms, self.diagnostics, self.sampling)

    @cached_property
    def excluded_windows(self) -> DataFrame:
        return sampling.excluded_windows(self.diagnostics)

    @cached_property
    def converted(self) -> tuple[DataFrame, DataFrame]:
        return pairs.convert(self.sample, self.pairing.window_id_col, self.pairing.vowel_seq_col, self.pairing.min_vowels)

    @cached_property
    def weighted_pairs(self) -> DataFrame:
        return pairs.weighted_pairs(self.converted[0])

    @cached_property
    def pair_diagnostics(self) -> DataFrame:
        return pairs.pair_diagnostics(self.sample)

    @cached_property
    def selected_token_rows(self) -> DataFrame:
        return sampling.selected_token_rows(self.token_rows, self.sample, self.sampling)

    @cached_property
    def baseline_details(self) -> DataFrame:
        return pairs.baseline_details(self.converted[0], initial_i=self.initial_i)

    @cached_property
    def baseline(self) -> DataFrame:
        return pairs.baseline_by_window(self.baseline_details)

    @cached_property
    def learned(self) -> DataFrame:
        return checkpoint(learning.learn(self.weighted_pairs, mode=self.mode))

    @cached_property
    def results(self) -> DataFrame:
        summary = learning.with_baseline(learning.results(self.learned), self.baseline)
        return summary.join(learning.top_contexts(learning.failure_contexts(learning.exploded(self.learned, "events"))), "time_window_id", "left")

    def write(self, folder: str) -> None:
        """All results and settings of a run below `folder`, with the names and columns of the stages' files."""
        files.write_csv(self.sample, f"{folder}/sampled_time_window_wordforms", order=["time_window_start", "frequency_rank_in_window"])
        files.write_csv(self.selected_token_rows, f"{folder}/sampled_time_window_original_token_rows")
        write_in_order(sampling.with_sample_sizes(self.diagnostics, self.sampling), f"{folder}/time_window_diagnostics", layout.DIAGNOSTICS, order=["time_window_start"])
        write_in_order(self.excluded_windows, f"{folder}/excluded_time_windows", layout.DIAGNOSTICS)
        files.write_csv(self.converted[0], f"{folder}/d2l_core/d2l_wordforms")
        files.write_csv(self.converted[1], f"{folder}/d2l_core/d2l_excluded_wordforms")
        files.write_csv(self.weighted_pairs, f"{folder}/d2l_core/d2l_weighted_pairs")
        write_in_order(self.pair_diagnostics, f"{folder}/d2l_core/d2l_window_diagnostics", layout.PAIR_DIAGNOSTICS)
        files.write_window_pairs(self.weighted_pairs, f"{folder}/d2l_core/window_pairs")
        write_in_order(self.baseline, f"{folder}/baseline/baseline_exception_rate_by_window", layout.BASELINE, order=["time_window_start"])
        files.write_csv(self.baseline_details, f"{folder}/baseline/baseline_wordform_details")
        write_in_order(self.results, f"{folder}/d2l_results/d2l_results_by_window", layout.RESULTS, order=["time_window_start"])
        for what, name in (("trace", "d2l_learning_trace"), ("events", "d2l_failed_predictions"), ("predictions", "d2l_pair_predictions")):
            files.write_csv(learning.exploded(self.learned, what), f"{folder}/d2l_results/{name}")
        contexts = learning.failure_contexts(learning.exploded(self.learned, "events"))
        files.write_csv(contexts, f"{folder}/d2l_results/d2l_failure_context_summary")
        files.write_csv(learning.initial_harmony(contexts), f"{folder}/d2l_results/d2l_initial_harmony_failure_context_summary")
        files.write_csv(learning.failure_targets(learning.exploded(self.learned, "events")), f"{folder}/d2l_results/d2l_failure_target_summary")
        for settings, name, derived in (
            (self.sampling, "sampling_config", {"anchor_year": sampling.anchor_year(self.token_rows, self.sampling)}), (self.pairing, "d2l_core/d2l_input_config", {}),
            (config.Baseline(initial_i_policy=self.initial_i), "baseline/baseline_analysis_config", {}), (config.Learning(mode=self.mode), "d2l_results/d2l_run_config", {}),
        ):
            files.write_text(self.raw.sparkSession, config.as_json(settings, **derived), f"{folder}/{name}.json")


def preprocess(spark: SparkSession, settings: config.Preprocessing, partitions: int | None = None, identify=None, identify_records=None) -> tuple[DataFrame, dict[str, int]]:
    """Stage 01 from files to files: each has its result in the same place below output_dir. Results that are there are left alone.

    All files that are to be done make one job. Gives the documents of all results, and the counts of
    what this run has read. The identifiers are those of documents.profile() and documents.classify().
    """
    found = files.discover(settings.input_dir, settings.input_patterns)
    target = {p: str(files.output_path(p, settings.input_dir, settings.output_dir)) for p in found}
    todo = [p for p in found if not (settings.skip_existing_output and files.exists(spark, target[p]))]
    counts: dict[str, int] = {}
    if todo:
        raw, seen = files.read_documents(spark, [str(p) for p in todo], glob="*")
        uris = spark.read.text([str(p) for p in todo]).inputFiles()
        where = {Path(unquote(urlparse(u).path)): u for u in uris}
        raw = raw.repartition(partitions) if partitions else raw
        done = documents.dotted_scripts(documents.classify(documents.profile(raw, identify), identify_records))
        files.write_documents_by_file(done, {where[p.resolve()]: target[p] for p in todo})
        counts = seen.get
    return spark.read.schema(files.PROCESSED).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(settings.output_dir), counts
