"""First N items of every group, by skipping row groups on their statistics.

The rows are written once, clustered by group and, within a group, by rank. A group with a large
part of all rows spreads over many files and row groups, each with its own range of ranks. The
footers then tell which row groups lie within one group and how high their scores go; row groups are
read in descending order of the highest score, and those are skipped in which no row can be among the
first N of any group that they hold. So a group of any size costs its first row groups, and no task
holds more than one. The layout can be kept, so that later reads cost nothing else.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hanstrata.runtime import checkpoint, exists, move, remove, require_columns, work_path

#: Row groups that a file has about, and the fewest and most rows of one.
ROW_GROUPS_PER_FILE, LEAST_ROWS, MOST_ROWS = 16, 1 << 10, 1 << 20
#: Rows of a file at most; there are as many files as shuffle partitions at least.
ROWS_PER_FILE = 1 << 23
_UNITS = "unit string, path string, row_group int, whole_group boolean, bound binary, one_item string"


def open_file(uri: str) -> pq.ParquetFile:
    """A Parquet file of any file system that Arrow reads; s3a is what Hadoop calls s3."""
    from pyarrow.fs import FileSystem

    uri = unquote(uri)
    scheme, _, rest = uri.partition("://")
    fs, path = FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)
    return pq.ParquetFile(fs.open_input_file(path))


class Rank:
    """Where a row stands in its group: score descending, then ties and item ascending, nulls last.

    Values are compared as they are, never as doubles; strings by code point, as bytes are in Parquet.
    """

    __slots__ = ("parts",)

    def __init__(self, score, rest: tuple):
        self.parts = (score, *rest)

    def __lt__(self, other: Rank) -> bool:
        for k, (a, b) in enumerate(zip(self.parts, other.parts, strict=True)):
            if a is None or b is None:
                if (a is None) != (b is None):
                    return b is None
            elif a != b:
                return a > b if k == 0 else a < b
        return False


def _value(v):
    """A value as it is ranked: what pandas makes of null is None."""
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    return v.item() if hasattr(v, "item") else v


def footers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The row groups of files, each with the best rank that any row of it can have.

    No row ranks before the highest score with the least of each tie. A row group of one group
    belongs to that group's unit, the others of a file are one unit. Without statistics there is no bound.
    """
    for frame in frames:
        rows = []
        for path in frame["path"]:
            meta = open_file(path).metadata
            column = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
            ties = sorted((c for c in column if c[0] == "t" and c[1:].isdigit()), key=lambda c: int(c[1:]))
            for k in range(meta.num_row_groups):
                stats = {c: meta.row_group(k).column(column[c]).statistics for c in ("g", "score", "item", *ties)}
                known = lambda c: stats[c] is not None and stats[c].has_min_max  # noqa: E731, B023
                empty = lambda c: stats[c] is not None and stats[c].has_null_count and stats[c].null_count == meta.row_group(k).num_rows  # noqa: E731, B023
                one = known("g") and stats["g"].min == stats["g"].max
                bound = None
                if known("score") and all(known(c) or empty(c) for c in (*ties, "item")):
                    bound = pickle.dumps((stats["score"].max, tuple(stats[c].min if known(c) else None for c in (*ties, "item"))))
                single = known("item") and stats["item"].min == stats["item"].max and stats["item"].has_null_count and not stats["item"].null_count
                rows.append((f"g{stats['g'].min}" if one else f"f{path}", path, k, one, bound, str(stats["item"].min) if single else None))
        yield pd.DataFrame(rows, columns=["unit", "path", "row_group", "whole_group", "bound", "one_item"])


@dataclass
class Read:
    """What a unit gave: its groups' first rows, and how many row groups it has and needed."""

    rows: pd.DataFrame | None
    n_row_groups: int
    n_read: int


def read_unit(row_groups: pd.DataFrame, n: int, ties: list[str]) -> Read:
    """The first n items of each group of a unit; row groups come in descending order of their bounds."""
    best: dict[str, dict] = {}  # of each group its first items: item -> (rank, row)
    last: dict[str, Rank] = {}  # the rank of each group's n-th item, once there is one
    todo = []
    for r in row_groups.itertuples(index=False):
        bound = Rank(*pickle.loads(r.bound)) if r.bound is not None else None
        todo.append((bound, r))
    todo.sort(key=lambda x: _Order(x[0]))
    n_read, files = 0, {}
    for bound, r in todo:
        if r.path not in files:
            files = {r.path: open_file(r.path)}  # one at a time
        held = [r.unit[1:]] if r.whole_group else None
        if bound is not None and last:
            if held is None:  # the groups that it holds, which take reading of one small column only
                held = files[r.path].read_row_group(int(r.row_group), columns=["g"])["g"].unique().to_pylist()
            if all(g in last and last[g] < bound for g in held):
                continue
        if r.whole_group and isinstance(r.one_item, str) and any(str(i) == r.one_item for i in best.get(held[0], {})) and bound is not None and not bound < best_of(best[held[0]], r.one_item):
            continue  # nothing but an item that is there already, with no better rank
        rows = files[r.path].read_row_group(int(r.row_group)).to_pandas(types_mapper=None, date_as_object=True, integer_object_nulls=True)
        n_read += 1
        names = [c for c in rows.columns]
        at = {c: k for k, c in enumerate(names)}
        seen: dict[str, int] = {}
        for row in rows.itertuples(index=False, name=None):
            g = row[at["g"]]
            if seen.get(g, 0) >= n:  # rows of a group lie in order of rank: the first n items of a row group are enough
                continue
            rank = Rank(_value(row[at["score"]]), (*(_value(row[at[t]]) for t in ties), _value(row[at["item"]])))
            mine = best.setdefault(g, {})
            item = _value(row[at["item"]])
            if item not in mine:
                seen[g] = seen.get(g, 0) + 1
                mine[item] = (rank, row)
            elif rank < mine[item][0]:
                mine[item] = (rank, row)
        for g in seen:
            first = sorted(best[g].items(), key=lambda p: _Order(p[1][0]))[:n]
            best[g] = dict(first)
            if len(first) == n:
                last[g] = first[-1][1][0]
    rows = [row for mine in best.values() for _, row in mine.values()]
    return Read(pd.DataFrame(rows, columns=names, dtype=object) if rows else None, len(todo), n_read)


def best_of(items: dict, name: str) -> Rank:
    return next(rank for item, (rank, _) in items.items() if str(item) == name)


class _Order:
    """Sorts ranks; no rank comes first."""

    __slots__ = ("rank",)

    def __init__(self, rank: Rank | None):
        self.rank = rank

    def __lt__(self, other: _Order) -> bool:
        if self.rank is None or other.rank is None:
            return self.rank is None and other.rank is not None
        return self.rank < other.rank


def cluster(df: DataFrame, path: str, rows_per_group: int | None = None) -> None:
    """Writes rows (g, score, ties, item, ...) so that groups, and ranks within a group, lie together."""
    n, ties = df.count(), sorted((c for c in df.columns if c[0] == "t" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    n_files = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_PER_FILE))
    size = rows_per_group or min(MOST_ROWS, max(LEAST_ROWS, -(-n // (n_files * ROW_GROUPS_PER_FILE))))
    order = [F.col("g"), F.desc("score"), *(F.col(t).asc_nulls_last() for t in ties), F.col("item").asc_nulls_last()]
    df.repartitionByRange(n_files, *order).sortWithinPartitions(*order).write.mode("overwrite").option("parquet.block.row.count.limit", size).parquet(path)


def _named(df: DataFrame, group: list[str], item: str, score: str, ties: list[str]) -> DataFrame:
    require_columns(df, *group, item, score, *ties)
    named = {f"k{i}": c for i, c in enumerate(group)} | {"item": item, "score": score} | {f"t{i}": c for i, c in enumerate(ties)}
    rows = df.select(*(F.col(f"`{c}`").alias(k) for k, c in named.items()))
    fractions = [f.name for f in rows.schema if isinstance(f.dataType, T.FloatType | T.DoubleType)]
    rows = rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in fractions}).where(F.col("score").isNotNull())
    return rows.withColumn("g", F.to_json(F.struct(*(F.col(f"k{i}").alias(f"k{i}") for i in range(len(group))))))


def _layout(rows: DataFrame, keep: str | None) -> str:
    """Where the clustered rows are; those that are kept are written once, and are there as a whole or not at all."""
    if keep is not None and exists(rows.sparkSession, f"{keep}/_SUCCESS"):
        return keep
    path = work_path(rows.sparkSession, "clustered")
    cluster(rows, path)
    if keep is None:
        return path
    move(rows.sparkSession, path, keep)
    return keep


def _units(rows: DataFrame, path: str) -> DataFrame:
    """The row groups of a layout, spread over tasks by unit; statistics are few bytes for much reading, so not by size."""
    spark = rows.sparkSession
    files = spark.read.schema(rows.schema).parquet(path).inputFiles()
    cores = spark.sparkContext.defaultParallelism
    names = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, min(len(files), 4 * cores)))
    return names.mapInPandas(footers, _UNITS).repartition(max(1, min(4 * len(files), 64 * cores)), "unit")


def top_items(df: DataFrame, group: list[str], item: str, score: str, ties: list[str], n: int, rank_name: str = "rank", keep: str | None = None) -> DataFrame:
    """The first n items of every group: columns group, rank_name, item, score, ties.

    Order: `score` descending, then `ties` ascending with nulls last, then the item; strings by code
    point; ranks run from 1 without gaps. An item that occurs more than once in a group counts once,
    with its best row. Rows whose score is null or no number (NaN) are left out, a tie that is no
    number counts as null; nulls in the group columns are values like any other; a null item is an
    item. Groups with fewer than n items give all; an empty table gives no row. Extra columns are not
    read, whatever their names.

    `keep` names a folder for the clustered layout. If it is there, it is read in place of `df`,
    which then is not read at all: the name must tell what the layout was made of.
    """
    rows = _named(df, group, item, score, ties)
    spark, tie_names = df.sparkSession, [f"t{i}" for i in range(len(ties))]
    path = _layout(rows, keep)
    out = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema])

    def read(key: tuple, row_groups: pd.DataFrame) -> pd.DataFrame:
        best = read_unit(row_groups, n, tie_names).rows
        return best[[f.name for f in out]] if best is not None else pd.DataFrame(columns=[f.name for f in out])

    # at most n rows from each unit that holds a part of the group
    found = _units(rows, path).groupBy("unit").applyInPandas(read, out)
    if keep is None:  # once they are there, the clustered rows can go
        found = checkpoint(found)
        remove(spark, path)
    order = [F.desc("score"), *(F.col(t).asc_nulls_last() for t in tie_names), F.col("item").asc_nulls_last()]
    found = found.withColumn("again", F.row_number().over(W.partitionBy("g", "item").orderBy(*order))).where("again = 1")
    found = found.withColumn("place", F.row_number().over(W.partitionBy("g").orderBy(*order))).where(F.col("place") <= n)
    named = {"item": item, "score": score} | dict(zip(tie_names, ties, strict=True))
    return found.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(group)), F.col("place").cast("int").alias(rank_name), *(F.col(k).alias(c) for k, c in named.items()))


def row_group_report(df: DataFrame, group: list[str], item: str, score: str, ties: list[str], n: int, keep: str | None = None) -> DataFrame:
    """(n_units, n_row_groups, n_read, n_skipped) of what top_items() reads for the same arguments; zeros for an empty table."""
    rows = _named(df, group, item, score, ties)
    tie_names, path = [f"t{i}" for i in range(len(ties))], _layout(rows, keep)

    def read(key: tuple, row_groups: pd.DataFrame) -> pd.DataFrame:
        done = read_unit(row_groups, n, tie_names)
        return pd.DataFrame([(done.n_row_groups, done.n_read)], columns=["n", "n_read"])

    units = _units(rows, path).groupBy("unit").applyInPandas(read, "n bigint, n_read bigint")
    if keep is None:
        units = checkpoint(units)
        remove(df.sparkSession, path)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return units.agg(F.count("*").alias("n_units"), total("n").alias("n_row_groups"), total("n_read").alias("n_read"), (total("n") - total("n_read")).alias("n_skipped"))
