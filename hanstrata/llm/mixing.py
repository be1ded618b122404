"""Mixing sources to target shares of tokens, with a cap on repeats.

Each source's texts are packed, in a pseudorandom order, into one stream of tokens that is cut into
blocks of a fixed length; the last block of a source may be shorter. The slots of a mix are spread
over output shards. Every shard draws how many of its slots each source gets: the whole part of
slots times share, and a multinomial draw for the rest. Slots that were drawn for a source beyond
its number go to the sources that were drawn too seldom, so that each gets exactly its own. The
slots of a source, numbered over all shards, are mapped to its blocks by a pseudorandom permutation
for each round through the source, so that no block is used more often than there are rounds; the
last slot takes only the tokens that are still due. Blocks are joined to their texts by their index.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hanstrata.runtime import checkpoint, require_columns

# Fixed value: how the vocabulary's owners cut text into pieces before they merge bytes.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS = 128
SLOTS_PER_SHARD = 1024
#: Shards whose draws one task adds up, and texts of a source that one task puts in order.
SHARDS_PER_GROUP, TEXTS_PER_BUCKET = 4096, 1 << 17


@lru_cache(maxsize=2)
def _encoder(data: bytes):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def encoder(path: str):
    """The tokenizer of a rank file."""
    return _encoder(Path(path).read_bytes())


def with_token_counts(df: DataFrame, text: str, vocabulary: str, name: str = "n_tokens") -> DataFrame:
    """df without `text`, with the number of its tokens in a public vocabulary; 0 for null and empty texts.

    The rank file, of less than a megabyte, is read here and sent along: executors need not have it.
    """
    require_columns(df, text)
    rest = [f for f in df.schema if f.name not in (text, name)]
    schema = df.select(*(F.col(f"`{f.name}`") for f in rest)).schema
    names = [f.name for f in rest]
    ranks = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(ranks.value)
        for batch in batches:
            counts = [len(own.encode_ordinary(t)) if t else 0 for t in batch[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(counts, pa.int64())], names=[*names, name])

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*schema.fields, T.StructField(name, T.LongType())]))


def normal_source(column: str):
    """The source's name: case, outer blanks and hyphens aside."""
    return F.regexp_replace(F.lower(F.trim(F.col(column))), "-", "_")


def packed(docs: DataFrame, seed: int, texts_per_bucket: int = TEXTS_PER_BUCKET) -> tuple[DataFrame, DataFrame]:
    """Texts (source, doc_id, n_tokens) with their first token's place in the source's stream; tokens of each source.

    Texts are spread over buckets by hash, of about `texts_per_bucket` texts each; a bucket is put in
    order by one task, and the buckets of a source follow each other. So a source with a third of all
    texts takes no longer than any other.
    """
    buckets = -(-docs.count() // texts_per_bucket) or 1
    hashed = F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed))
    rows = docs.withColumn("order", hashed).withColumn("bucket", F.pmod(F.col("order"), F.lit(buckets)))
    in_bucket = W.partitionBy("source", "bucket").orderBy("order", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("size"))
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("size").over(ahead), F.lit(0))).select("source", "bucket", "offset")
    placed = rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(in_bucket), F.lit(0)))
    placed = placed.join(offsets, ["source", "bucket"]).select("source", "doc_id", "n_tokens", (F.col("offset") + F.col("within")).alias("start"))
    return placed, sizes.groupBy("source").agg(F.sum("size").alias("tokens"))


def plan_mix(targets: pd.DataFrame, tokens: dict[str, int], block: int, total_tokens: int | None) -> pd.DataFrame:
    """What each source gives to one mix: (source, target_share, share, tokens, blocks, limit, planned, slots, unmet).

    Sources without a token, or that may not be used, take no part; their share goes to the others in
    proportion (`share`). Without `total_tokens` the mix is as large as its scarcest source allows.
    """
    plan = targets.copy()
    plan["tokens"] = np.array([tokens.get(s, 0) for s in plan["source"]], np.int64)
    plan["blocks"] = -(-plan["tokens"] // block)
    uses, wanted = plan["max_repeats"].fillna(0).clip(lower=0).astype(np.int64), plan["target_share"].fillna(0).clip(lower=0)
    plan["limit"] = plan["tokens"] * uses
    able = (plan["limit"] > 0) & (wanted > 0)
    plan["unmet"] = np.select([wanted <= 0, plan["tokens"] == 0, uses == 0], [None, "no tokens", "no use allowed"], None)
    plan["share"] = np.where(able, wanted, 0.0)
    plan["planned"] = plan["slots"] = np.int64(0)
    if not able.any():
        return plan
    plan["share"] /= plan["share"].sum()
    most = int(np.floor((plan["limit"][able] / plan["share"][able]).min()))
    size = min(most, total_tokens) if total_tokens is not None else most
    if total_tokens is not None and size < total_tokens:
        plan.loc[able & (np.floor(plan["share"] * total_tokens) > plan["limit"]), "unmet"] = "repeats used up"
    exact = plan["share"] * size
    planned = np.floor(exact).astype(np.int64)
    for i in (exact - planned).sort_values(ascending=False, kind="stable").index[: int(size - planned.sum())]:
        planned[i] += 1
    plan["planned"] = np.minimum(planned, plan["limit"])
    whole, rest = np.divmod(plan["planned"].to_numpy(), np.maximum(plan["tokens"].to_numpy(), 1))
    plan["slots"] = whole * plan["blocks"] + -(-rest // block)
    return plan


def shard_counts(shares: np.ndarray, slots: int, rng: np.random.Generator) -> np.ndarray:
    """How many slots of a shard each source gets: whole parts, and a multinomial draw for the rest."""
    whole = np.floor(shares * slots + 1e-9).astype(np.int64)
    rest = np.maximum(shares * slots - whole, 0)
    left = slots - int(whole.sum())
    return whole + (rng.multinomial(left, rest / rest.sum()) if left > 0 and rest.sum() > 0 else 0)


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n), at `index`: a Feistel network that walks its cycle into the range."""
    if n < 2:
        return np.zeros_like(index)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x = index.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for r in range(4):
            f = (right + np.uint64((key * 0x9E3779B1 + r * 0x85EBCA77 + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(29)
            left, right = right, left ^ (f * np.uint64(0x94D049BB133111EB) >> np.uint64(32)) & mask
        x[todo] = left << np.uint64(half) | right
        todo &= x >= np.uint64(n)
    return x.astype(np.int64)


def mix(docs: DataFrame, doc_id: str, text: str, source: str, targets: DataFrame, vocabulary: str, total_tokens: int | None = None, block: int = BLOCK_TOKENS, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """Combines texts so that each source of a mix has its share of all tokens.

    `targets` has (mix_name, source, target_share, max_repeats), a fixed table; `vocabulary` is the
    path of a rank file. Returns the pieces and the plan. Pieces (mix_name, shard, slot, source,
    block, repeat, doc_id, from_token, n_tokens): in reading order of shard, slot and from_token
    within the block; `repeat` tells how often the block was used before. The plan, a row for each
    mix and source: target_share, share (of sources that can take part), max_repeats,
    available_tokens, limit_tokens, planned_tokens, and `unmet`, why a target share can't be met.

    No token is used more than max_repeats times, all tokens of a source can be used, and each mix
    has exactly its planned tokens. A slot holds a block, but for a source's last block, which may be
    shorter, and for the last slot of a source, which takes what is still due. Texts that are null,
    empty or of a source in no mix take no part; spellings of a source's name are one source. Equal
    texts under different ids are different texts. Without texts both results have no piece.
    """
    require_columns(docs, doc_id, text, source)
    require_columns(targets, "mix_name", "source", "target_share", "max_repeats")
    spark = docs.sparkSession
    wanted = targets.select(normal_source("source").alias("source")).distinct()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), normal_source(source).alias("source"))
    rows = rows.where(F.length("text") > 0).join(F.broadcast(wanted), "source", "left_semi")
    counted = checkpoint(with_token_counts(rows, "text", vocabulary).where("n_tokens > 0"))
    placed, sizes = packed(counted, seed)
    tokens = {r["source"]: r["tokens"] for r in sizes.collect()}  # a row for each source of the mixes
    given = targets.withColumn("source", normal_source("source")).toPandas()
    plans = {name: plan_mix(mine.sort_values("source").reset_index(drop=True), tokens, block, total_tokens) for name, mine in given.groupby("mix_name", sort=True)}
    slots = _slots(spark, plans, block, seed)
    span = F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("n_tokens") - 1) / block)))
    parts = placed.select("source", "doc_id", "start", "n_tokens", span.alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * block)
    parts = parts.select("source", "block", "doc_id", (begin - F.col("start")).alias("from_token"), (begin - F.col("block") * block).alias("within"), (F.least(F.col("start") + F.col("n_tokens"), (F.col("block") + 1) * block) - begin).alias("n_tokens"))
    # both sides grow with the texts, and the size of what Python makes is unknown to the planner: never broadcast
    pieces = slots.hint("merge").join(parts.hint("merge"), ["source", "block"]).withColumn("n_tokens", F.least(F.col("n_tokens"), F.col("due") - F.col("within"))).where("n_tokens > 0")
    pieces = pieces.select("mix_name", "shard", "slot", "source", "block", "repeat", "doc_id", "from_token", "n_tokens")
    report = [(name, r.source, r.target_share, r.share, r.max_repeats, r.tokens, r.limit, r.planned, r.unmet) for name, p in plans.items() for r in p.itertuples(index=False)]
    kind = "mix_name string, source string, target_share double, share double, max_repeats int, available_tokens bigint, limit_tokens bigint, planned_tokens bigint, unmet string"
    python = lambda v: None if v is None or pd.isna(v) else v.item() if isinstance(v, np.generic) else v
    return pieces, spark.createDataFrame([(*map(python, r[:4]), None if pd.isna(r[4]) else int(r[4]), *map(python, r[5:])) for r in report], kind)


class Draws:
    """The slots of all mixes, by shard: every count follows from the shard's number and the seed."""

    def __init__(self, plans: dict[str, pd.DataFrame], seed: int, slots_per_shard: int):
        self.names, self.seed, self.size = list(plans), seed, slots_per_shard
        self.sources = [p["source"].tolist() for p in plans.values()]
        self.tokens, self.blocks, self.slots, self.planned = ([p[c].to_numpy(np.int64) for p in plans.values()] for c in ("tokens", "blocks", "slots", "planned"))
        self.total = np.array([int(s.sum()) for s in self.slots], np.int64)
        self.first_shard = np.append(0, np.cumsum(-(-self.total // slots_per_shard)))

    def shard(self, number: int) -> tuple[int, int, int]:
        """(mix, its shard, slots) of a shard's number over all mixes."""
        m = int(np.searchsorted(self.first_shard, number, side="right") - 1)
        k = number - int(self.first_shard[m])
        return m, k, min(self.size, int(self.total[m]) - k * self.size)

    def counts(self, m: int, k: int, n: int) -> np.ndarray:
        return shard_counts(self.slots[m] / self.total[m], n, np.random.default_rng([self.seed, m, k]))


def _slots(spark, plans: dict[str, pd.DataFrame], block: int, seed: int, slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """(mix_name, shard, slot, source, block, repeat, due) of all slots, made by the shards' tasks; `due` are the tokens of the block that count.

    Draws are made in tasks, and added up over the shards before by groups of shards, then by group.
    """
    draws = Draws(plans, seed, slots_per_shard)
    n_shards = int(draws.first_shard[-1])

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for number in frame["id"].tolist():
                m, k, n = draws.shard(number)
                counts = draws.counts(m, k, n)
                out += [(m, k, n, s, int(at), int(c)) for s, (c, at) in enumerate(zip(counts, np.cumsum(counts) - counts, strict=True)) if c]
            yield pd.DataFrame(out, columns=["mix", "shard", "slots", "source", "at", "n"])

    drawn = spark.range(n_shards).mapInPandas(draw, "mix int, shard bigint, slots int, source int, at int, n bigint").withColumn("part", F.expr(f"shard div {SHARDS_PER_GROUP}"))
    sums = drawn.groupBy("mix", "source", "part").agg(F.sum("n").alias("in_part"))
    before = lambda *by: W.partitionBy(*by).rowsBetween(W.unboundedPreceding, -1)
    parts = sums.withColumn("ahead", F.coalesce(F.sum("in_part").over(before("mix", "source").orderBy("part")), F.lit(0))).drop("in_part")
    first = F.col("ahead") + F.coalesce(F.sum("n").over(before("mix", "source", "part").orderBy("shard")), F.lit(0))
    rows = drawn.join(parts, ["mix", "source", "part"]).select("mix", "shard", "slots", "source", "at", "n", first.alias("first"))
    excess = [np.zeros(len(s), np.int64) for s in draws.slots]
    got = [np.zeros(len(s), np.int64) for s in draws.slots]
    for r in sums.groupBy("mix", "source").agg(F.sum("in_part").alias("n")).collect():  # a row for each mix and source
        got[r["mix"]][r["source"]] = r["n"]
    for m, own in enumerate(draws.slots):
        excess[m] = np.maximum(got[m] - own, 0)

    lacking = [np.maximum(own - g, 0) for own, g in zip(draws.slots, got, strict=True)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for m, rows in frame.groupby("mix", sort=False):
                yield of_mix(int(m), rows)

    def of_mix(m: int, rows: pd.DataFrame) -> pd.DataFrame:
        n = rows["n"].to_numpy()
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        source, ordinal, shard = (np.repeat(x, n) for x in (rows["source"].to_numpy(), rows["first"].to_numpy(), rows["shard"].to_numpy()))
        ordinal = ordinal + within
        over = np.flatnonzero(ordinal >= draws.slots[m][source])
        if len(over):  # these go to the sources that were drawn too seldom, in order
            number = (np.cumsum(excess[m]) - excess[m])[source[over]] + ordinal[over] - draws.slots[m][source[over]]
            source[over] = np.searchsorted(np.cumsum(lacking[m]), number, side="right")
            ordinal[over] = got[m][source[over]] + number - (np.cumsum(lacking[m]) - lacking[m])[source[over]]
        repeat, index = np.divmod(ordinal, draws.blocks[m][source])
        # rounds of a source, one after the other
        rounds = source * (repeat.max() + 1) + repeat
        order = np.argsort(rounds, kind="stable")
        where = index.copy()
        for mine in np.split(order, np.flatnonzero(np.diff(rounds[order])) + 1):
            s, r = int(source[mine[0]]), int(repeat[mine[0]])
            whole = int(draws.tokens[m][s]) // block  # a shorter block is the last of each round
            mine = mine[index[mine] < whole]
            where[mine] = permuted(index[mine], whole, hash((seed, m, s, r)) & 0x7FFFFFFF)
        due = np.full(len(ordinal), block)
        last = ordinal == draws.slots[m][source] - 1
        due[last] = (draws.planned[m][source] - repeat * draws.tokens[m][source] - index * block)[last]
        shuffled = {k: np.random.default_rng([seed, m, k, 1]).permutation(size) for k, size in dict(zip(rows["shard"].tolist(), rows["slots"].tolist(), strict=True)).items()}
        slot = np.concatenate([shuffled[k][at : at + c] for k, at, c in zip(rows["shard"].tolist(), rows["at"].tolist(), n.tolist(), strict=True)])
        return pd.DataFrame({"mix_name": draws.names[m], "shard": shard, "slot": slot, "source": np.array(draws.sources[m], object)[source], "block": where, "repeat": repeat, "due": due})

    # few bytes for much work, so these must not be put together by size
    spread = max(1, min(n_shards, 8 * spark.sparkContext.defaultParallelism))
    return rows.repartition(spread, "mix", "shard").mapInPandas(run, "mix_name string, shard bigint, slot int, source string, block bigint, repeat int, due bigint")


def mix_records(pieces: DataFrame) -> DataFrame:
    """(mix_name, source, doc_id, n_uses, n_tokens): each chosen text, how often at most a part of it is used, its tokens in the mix."""
    return pieces.groupBy("mix_name", "source", "doc_id").agg((F.max("repeat") + 1).alias("n_uses"), F.sum("n_tokens").alias("n_tokens"))


def mix_report(pieces: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with actual_tokens and actual_share of each source."""
    used = pieces.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("actual_tokens"))
    total = used.groupBy("mix_name").agg(F.sum("actual_tokens").alias("all_tokens"))  # a row for each mix
    return plan.join(used, ["mix_name", "source"], "left").join(F.broadcast(total), "mix_name", "left").withColumns({
        "actual_tokens": F.coalesce("actual_tokens", F.lit(0)), "actual_share": F.coalesce(F.col("actual_tokens") / F.col("all_tokens"), F.lit(0.0)),
    }).drop("all_tokens")
