"""Per-key results under extreme skew, by dense accumulator arrays.

Each input split encodes its keys in a dictionary and adds its rows up with bincount and
scatter-reduce, so that a key that owns a third of all rows costs what any other row costs and
leaves the split as one array cell. The arrays travel in blocks, chosen by the hash of the key,
and blocks are summed in parallel. No row of a hot key is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hanstrata.runtime import require_columns

#: Rows that a split encodes at once: bounds the dictionary and the arrays of a task.
ROWS_PER_ENCODING = 1 << 18
_LOW, _HIGH = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def _accumulate(keys: pa.Array, counts, low, high):
    """Dictionary-encodes keys and reduces the arrays by code: keys in order of first occurrence, the arrays, and the code of each row."""
    encoded = keys.dictionary_encode()
    code = encoded.indices.to_numpy(zero_copy_only=False)
    n = len(encoded.dictionary)
    if counts is None:
        total = np.bincount(code, minlength=n).astype(np.int64)
    else:
        total = np.zeros(n, np.int64)
        np.add.at(total, code, counts)
    lowest, highest = np.full(n, _LOW), np.full(n, _HIGH)
    np.minimum.at(lowest, code, low)
    np.maximum.at(highest, code, high)
    return encoded.dictionary, total, lowest, highest, code


def _filled(column: pa.ChunkedArray | pa.Array, empty: int) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), empty).to_numpy(zero_copy_only=False)


def _split_arrays(n_blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            block_of = t["block"].combine_chunks() if t["block"].num_chunks != 1 else t["block"].chunk(0)
            keys = t["key"].chunk(0) if t["key"].num_chunks == 1 else t["key"].combine_chunks()
            names, total, low, high, code = _accumulate(keys, None, _filled(t["low"].chunk(0), _LOW), _filled(t["high"].chunk(0), _HIGH))
            block = np.zeros(len(names), np.int32)
            block[code] = block_of.to_numpy(zero_copy_only=False)
            order = np.argsort(block, kind="stable")
            cuts = np.searchsorted(block[order], np.arange(n_blocks + 1)).astype(np.int32)
            used = np.flatnonzero(np.diff(cuts))
            offsets = pa.array(np.append(cuts[used], cuts[-1]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, a) for a in (names.take(pa.array(order)), *(pa.array(x[order]) for x in (total, low, high)))]
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *lists], names=["block", "keys", "counts", "lows", "highs"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= ROWS_PER_ENCODING:
                yield from flush()
                held, rows = [], 0
        if rows:
            yield from flush()

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the blocks of one partition; what it holds is one cell for each distinct key."""
    parts: list[tuple] = []
    waiting = held = 0

    def reduce() -> None:
        nonlocal parts, waiting, held
        keys = pa.concat_arrays([p[0] for p in parts])
        parts = [_accumulate(keys, *(np.concatenate([p[i] for p in parts]) for i in (1, 2, 3)))[:4]]
        waiting, held = 0, len(parts[0][0])

    for batch in batches:
        if batch.num_rows:
            parts.append((batch["keys"].flatten(), *(batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("counts", "lows", "highs"))))
            waiting += len(parts[-1][0])
            if waiting > max(ROWS_PER_ENCODING, held):
                reduce()
    if parts:
        reduce()
        keys, total, low, high = parts[0]
        yield pa.RecordBatch.from_arrays(
            [keys, pa.array(total), pa.array(low, mask=low == _LOW), pa.array(high, mask=high == _HIGH)], names=["key", "n_rows", "low", "high"]
        )


def key_totals(df: DataFrame, key: str, low: str | None = None, high: str | None = None, n_blocks: int | None = None) -> DataFrame:
    """Rows, least `low` and greatest `high` of each value of the string column `key`.

    Returns (key, n_rows, low, high). `low` and `high` default to no column (null results); they
    are cut to whole numbers. Null keys are left out, the empty string is a key like any other;
    every stored row counts, repeats included. Nulls in `low` or `high` are passed over, and a key
    that has nothing else gets null. Other columns, whatever their names, are not read. An empty
    table gives an empty result.

    Needs one pass and one shuffle of at most one cell for each key and ROWS_PER_ENCODING rows.
    """
    require_columns(df, key, *(c for c in (low, high) if c))
    n_blocks = n_blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    number = lambda c: F.lit(None).cast("bigint") if c is None else F.col(f"`{c}`").cast("bigint")
    key_col = F.col(f"`{key}`").cast("string")
    rows = df.select(
        key_col.alias("key"), F.pmod(F.xxhash64(key_col), F.lit(n_blocks)).cast("int").alias("block"), number(low).alias("low"), number(high).alias("high")
    ).where(F.col("key").isNotNull())
    blocks = rows.mapInArrow(_split_arrays(n_blocks), "block int, keys array<string>, counts array<bigint>, lows array<bigint>, highs array<bigint>")
    return blocks.repartition("block").mapInArrow(_sum_blocks, "key string, n_rows bigint, low bigint, high bigint")


def key_window_totals(df: DataFrame, key: str, window: list[str], low: str | None = None, high: str | None = None) -> DataFrame:
    """Rows, distinct windows, least `low` and greatest `high` of each key.

    Returns (key, n_rows, n_windows, low, high). A window is a combination of the columns
    `window`; rows with a null in them count as rows, not as a window. Nulls, repeats and empty
    tables as in key_totals. The pair of key and window is the dense key, so a key with most rows
    reaches the second, ordinary aggregation as one row for each of its windows and splits.
    """
    require_columns(df, key, *window)
    parts = T.StructType([T.StructField("k", T.StringType()), T.StructField("w", T.StringType())])
    whole = F.when(F.greatest(*(F.col(f"`{c}`").isNull().cast("int") for c in window)) == 0, F.to_json(F.array(*(F.col(f"`{c}`").cast("string") for c in window))))
    pair = df.where(F.col(f"`{key}`").isNotNull()).select(
        F.to_json(F.struct(F.col(f"`{key}`").cast("string").alias("k"), whole.alias("w"))).alias("pair"),
        (F.lit(None).cast("bigint") if low is None else F.col(f"`{low}`").cast("bigint")).alias("low"),
        (F.lit(None).cast("bigint") if high is None else F.col(f"`{high}`").cast("bigint")).alias("high"),
    )
    cells = key_totals(pair, "pair", "low", "high").withColumn("p", F.from_json("key", parts))
    return cells.groupBy(F.col("p.k").alias("key")).agg(
        F.sum("n_rows").alias("n_rows"), F.count("p.w").alias("n_windows"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def heavy_keys(df: DataFrame, key: str, min_share: float) -> DataFrame:
    """(key, n_rows) of the values that hold at least `min_share` of the rows with a key.

    Ties at the limit are all in. At most 1 / min_share rows come out; an empty table or a column
    of nulls gives none.
    """
    if not 0 < min_share <= 1:
        raise ValueError("min_share lies in (0, 1]")
    require_columns(df, key)
    total = df.agg(F.count(F.col(f"`{key}`"))).first()[0]
    return key_totals(df, key).where(F.col("n_rows") >= F.lit(min_share * total)).select("key", "n_rows")
