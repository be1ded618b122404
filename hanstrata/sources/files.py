"""Readers and writers of the stages' files."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hanstrata.functions.inventory import SEGMENTS
from hanstrata.operators.documents import OPTIONAL
from hanstrata.runtime import exists, move, remove, require_columns

BYTE_ORDER_MARK = "\ufeff"

RAW = T.StructType([T.StructField(c, {"string": T.StringType(), "double": T.DoubleType()}[t]) for c, t in OPTIONAL.items()])
PROCESSED = T.StructType([*RAW.fields, T.StructField("language_score", T.DoubleType()), T.StructField("category", T.StringType()), *(T.StructField(f"script.{k}", T.DoubleType()) for k in ("kor", "oko", "jpn", "han", "lat"))])


def discover(folder: str | Path, patterns: Iterable[str] = ("*.jsonl", "*.jsonl.gz")) -> list[Path]:
    """All files below a local folder that match a pattern, once each, in order. Raises FileNotFoundError for none."""
    found = sorted({p for pattern in patterns for p in Path(folder).rglob(pattern) if p.is_file()})
    if not found:
        raise FileNotFoundError(f"no file below {folder} matches {', '.join(patterns)}")
    return found


def output_path(path: str | Path, input_dir: str | Path, output_dir: str | Path) -> Path:
    """Where a processed file goes: the same place below output_dir, as <stem>.processed.jsonl."""
    relative = Path(path).relative_to(input_dir)
    return Path(output_dir) / relative.parent / (re.sub(r"\.jsonl(\.gz)?$", "", relative.name) + ".processed.jsonl")


def _readable(schema: T.StructType) -> T.StructType:
    """How a line is read before its values are judged: `text` as it stands, the rest as strings."""
    fields = [T.StructField(f.name, T.VariantType() if f.name == "text" else T.StringType()) for f in schema.fields]
    return T.StructType([*fields, T.StructField("_broken", T.StringType())])


def judged(lines: DataFrame, schema: T.StructType = RAW) -> DataFrame:
    """Lines read by _readable(), with the columns of `schema` and `_text_is_string`.

    A value that is no number is null in a column of numbers, and its document stays.
    """
    out = lines.withColumn("_text_is_string", F.coalesce(F.schema_of_variant("text") == "STRING", F.lit(False)))
    typed = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType.simpleString()) for f in schema.fields if f.name != "text" and f.dataType != T.StringType()}
    return out.withColumns({"text": F.when(F.col("_text_is_string"), F.try_variant_get("text", "$", "string"))} | typed)


def read_documents(spark: SparkSession, paths: str | list[str], schema: T.StructType = RAW, glob: str = "*.{jsonl,jsonl.gz}", partitions: int | None = None) -> tuple[DataFrame, Observation]:
    """Documents of JSON lines below folders, with `input_file`; and a count of what was seen.

    Files may be gzipped, of which one is one task: give `partitions` to spread what follows. Blank
    lines are no documents. A line that is not JSON, or whose text is not a string (a number, a list,
    null or nothing), is counted and passed over. Columns that a file lacks are null. The observation
    has documents_seen, bad_lines, texts_not_strings and documents_used once a job has read all of it.
    """
    reader = spark.read.schema(_readable(schema)).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    df = judged(reader.json(paths).withColumn("input_file", F.input_file_name()), schema)
    seen, bad, good = Observation(), F.col("_broken").isNotNull(), F.col("_text_is_string")
    df = df.observe(seen, F.count("*").alias("documents_seen"), F.count_if(bad).alias("bad_lines"), F.count_if(~bad & ~good).alias("texts_not_strings"), F.count_if(~bad & good).alias("documents_used"))
    df = df.where(~bad & good).drop("_broken", "_text_is_string")
    return (df.repartition(partitions) if partitions else df), seen


def read_csv(spark: SparkSession, path: str | list[str], required: Iterable[str] = (), schema: T.StructType | None = None, line_breaks: bool = False) -> DataFrame:
    """A CSV with a header; a byte order mark is passed over. Required columns are checked from the header, before any job on rows.

    Files are split among tasks. Values with line breaks in them need `line_breaks`, and then one
    task reads a whole file.
    """
    reader = spark.read.option("header", True).option("multiLine", line_breaks).option("escape", '"').option("encoding", "UTF-8")
    df = (reader.schema(schema) if schema else reader).csv(path)
    if df.columns and df.columns[0].startswith(BYTE_ORDER_MARK):
        df = df.withColumnRenamed(df.columns[0], df.columns[0].lstrip(BYTE_ORDER_MARK))
    require_columns(df, *required)
    return df


def write_documents(df: DataFrame, path: str, skip_existing: bool = True) -> None:
    """JSON lines; what a finished job left is left alone, what a failed one left is written anew.

    A finished job is told by its _SUCCESS file; where the session writes none, all is written again.
    """
    if not (skip_existing and exists(df.sparkSession, f"{path}/_SUCCESS")):
        df.write.mode("overwrite").json(path)


def write_documents_by_file(df: DataFrame, targets: dict[str, str]) -> None:
    """JSON lines of each input file at a place of its own: a folder, which is there as a whole or not at all.

    `targets` leads from a value of `input_file` to its folder. One job writes all files next to the
    first folder, then each is put in its place by renaming. A file without documents gets an empty folder.
    """
    if not targets:
        return
    spark = df.sparkSession
    name = {file: f"{hashlib.md5(file.encode()).hexdigest()}" for file in targets}
    work = f"{next(iter(targets.values())).rsplit('/', 1)[0]}/.partial-{uuid.uuid4().hex}"
    df.withColumn("_file", F.md5("input_file")).drop("input_file").write.partitionBy("_file").json(work)
    for file, to in targets.items():
        move(spark, f"{work}/_file={name[file]}", to)
        write_text(spark, "", f"{to}/_SUCCESS")
    remove(spark, work)


def write_csv(df: DataFrame, path: str, columns: Iterable[str] | None = None, order: Iterable = ()) -> None:
    """CSV files with a byte order mark and a header; without rows, a file with the header only.

    With `columns` these and no others are written, in this order.
    """
    df = df.select(*(F.col(f"`{c}`") for c in columns)) if columns else df
    df = df.orderBy(*order) if order else df
    first = df.columns[0]
    df = df.select(F.col(f"`{first}`").alias(BYTE_ORDER_MARK + first), *(F.col(f"`{c}`") for c in df.columns[1:]))
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One file, in any file system that Spark writes to."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(to, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def safe_name(value: object) -> str:
    """A window's id as a file name."""
    return re.sub(r"[^0-9A-Za-z가-힣\-_.]", "_", str(value))


def write_window_pairs(pairs: DataFrame, path: str, window: str = "time_window_id") -> None:
    """One folder for each window, with a headerless TSV of ur, sr and weight, in this order."""
    name = F.regexp_replace(F.col(window).cast("string"), r"[^\p{L}\p{N}\-_.]", "_")
    rows = pairs.select(name.alias("window"), "d2l_ur", "d2l_sr", "lexical_type_weight")
    rows.repartition("window").sortWithinPartitions("window", "d2l_ur", "d2l_sr").write.mode("overwrite").partitionBy("window").option("sep", "\t").csv(path)


def read_window_pairs(spark: SparkSession, path: str) -> DataFrame:
    """The pairs of TSV files, with the window's id from the file's name or its folder's."""
    schema = "d2l_ur string, d2l_sr string, lexical_type_weight int"
    df = spark.read.schema(schema).option("sep", "\t").option("recursiveFileLookup", True).csv(path)
    file = F.input_file_name()
    folder = F.regexp_extract(file, r"window=([^/]+)/[^/]*$", 1)
    return df.withColumn("time_window_id", F.when(folder != "", folder).otherwise(F.regexp_extract(F.url_decode(file), r"([^/]+)\.tsv$", 1)))


def read_features(path: str | Path | None = None) -> dict[str, dict[str, str]]:
    """Features of segments from a TSV with the columns SEG and features; without a path, those of the core inventory."""
    if path is None:
        return SEGMENTS
    lines = [line.split("\t") for line in Path(path).read_text(encoding="utf-8-sig").splitlines() if line.strip()]
    head = lines[0]
    if head[0] != "SEG":
        raise ValueError("a feature file starts with the column SEG")
    return {row[0]: dict(zip(head[1:], row[1:], strict=True)) for row in lines[1:]}


#: Points that a chart may have.
MAX_POINTS = 100_000


def line_charts(summary: DataFrame, path: str | Path, columns: Iterable[str], x: str = "time_window_start") -> list[Path]:
    """A line chart for each column over the windows, where matplotlib is installed; else none.

    A summary has one row for each window. One with more than MAX_POINTS rows raises ValueError: it is no summary.
    """
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot
    except ImportError:
        return []
    if (n := summary.count()) > MAX_POINTS:
        raise ValueError(f"{n} windows are too many for a chart")
    rows = summary.orderBy(x).select(x, *columns).toPandas()
    out = []
    for c in columns:
        figure, axes = pyplot.subplots()
        axes.plot(rows[x], rows[c])
        axes.set_xlabel(x)
        axes.set_ylabel(c)
        out.append(Path(path) / f"{c}.png")
        out[-1].parent.mkdir(parents=True, exist_ok=True)
        figure.savefig(out[-1])
        pyplot.close(figure)
    return out
