"""The document and token stages as streams. Neither keeps state: years are numbers, and order doesn't matter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hanstrata.operators import documents, sampling, tokens
from hanstrata.sources import files


def read_documents(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """New JSON-line files below a folder, as a stream of raw documents; a finished file is never read again. Lines count as in files.read_documents()."""
    lines = spark.readStream.schema(files._readable(files.RAW)).option("columnNameOfCorruptRecord", "_broken").option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True).json(folder)
    return files.judged(lines).where("_broken is null and _text_is_string").drop("_broken", "_text_is_string")


def token_rows(raw: DataFrame, settings: tokens.Extraction = tokens.Extraction()) -> DataFrame:
    return tokens.token_rows(documents.classify(documents.profile(raw)), settings)


def write(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends rows as Parquet, each exactly once, until all files that are there have been read."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(rows: DataFrame, settings: sampling.Sampling = sampling.Sampling()) -> DataFrame:
    """Counts of word forms by window, as they grow; for output mode complete or update."""
    windowed = sampling._windowed(sampling.clean_rows(rows, settings), settings, settings.start_year or 0)
    return windowed.groupBy("time_window_id", "wordform_id").agg(F.count("*").alias("token_count_in_window"), F.min(settings.year_col).alias("first_year"), F.max(settings.year_col).alias("last_year"))
