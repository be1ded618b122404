"""Top items and frequent values against brute force."""

import os
import random
from collections import Counter

import pandas as pd
import pytest

from hanstrata.llm import heavy_hitters as hh
from hanstrata.llm import top_items as ti
from hanstrata.runtime import shared_dir


def test_top_values_are_exact(spark):
    rng = random.Random(1)
    rows = [(f"v{int(rng.paretovariate(0.7))}", None if rng.random() < 0.2 else rng.choice(["", "a", "b", "가"])) for _ in range(30_000)]
    df = spark.createDataFrame(rows, "x string, y string").repartition(6)
    got = hh.top_values(df, ["x", "y"], 12).collect()
    for column, k in (("x", 0), ("y", 1)):
        counts = Counter(r[k] for r in rows if r[k])
        want = sorted(counts.items(), key=lambda p: (-p[1], p[0]))[:12]
        mine = sorted((r for r in got if r["field_name"] == column), key=lambda r: r["place"])
        assert [(r["item_value"], r["n_rows"]) for r in mine] == want


def test_small_sketch_keeps_all_counts(monkeypatch):
    import numpy as np

    for name, value in (("BUCKETS", 32), ("CELLS", 2), ("COUNTERS", 64), ("RANGES", 4)):
        monkeypatch.setattr(hh, name, value)
    s, hashes = hh.Sketch(0, 32), np.arange(1, 5001, dtype=np.int64)
    for _ in range(3):
        s.add(hashes, hashes.astype(str).astype(object), np.ones(5000, np.int64))
    assert len(s.hash) <= 64 and s.votes.sum() + s.light.sum() == 15_000


def test_result_is_exact_where_most_values_are_evicted(spark):
    # more values than the sketch has cells, with small differences among the frequent ones
    rng = random.Random(4)
    rows = [(f"v{i}",) for i in range(120_000)] + [(f"v{i}",) for i in range(40) for _ in range(3 + i % 7)] + [("hot",)] * 900
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "x string").repartition(4)
    cells = hh.sketch(df, ["x"])
    assert cells.where("item is not null").count() == hh.BUCKETS * hh.CELLS and cells.where("item is null").agg({"votes": "sum"}).first()[0] > 0
    got = sorted(hh.top_values(df, ["x"], 15).collect(), key=lambda r: r["place"])
    want = sorted(Counter(r[0] for r in rows).items(), key=lambda p: (-p[1], p[0]))[:15]
    assert [(r["item_value"], r["n_rows"]) for r in got] == want


@pytest.mark.parametrize("rows", [[], [(None,)], [("",)]])
def test_top_values_of_nothing(spark, rows):
    assert hh.top_values(spark.createDataFrame(rows, "x string"), ["x"], 5).collect() == []


SCHEMA = "g string, h int, item string, score bigint, first int, rank string, k0 string"


def _want(rows, n):
    best = {}
    for r in rows:
        if r[3] is not None:
            key = (-r[3], r[4] is None, r[4] or 0, r[2] or "")
            at = (r[0], r[1], r[2])
            best[at] = min(best.get(at, key), key)
    groups = {}
    for (g, h, item), key in best.items():
        groups.setdefault((g, h), []).append((key, item))
    return sorted((str(g), h, i + 1, item) for (g, h), items in groups.items() for i, (_, item) in enumerate(sorted(items, key=lambda p: p[0])[:n]))


def test_top_items_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(6000):
        g = "hot" if rng.random() < 0.4 else f"g{rng.randrange(60)}"
        rows.append((g, rng.randrange(2), f"i{i}", None if rng.random() < 0.05 else rng.randrange(40), rng.choice([None, 1, 2, 3]), "x", "y"))
    rows += rows[:500]
    rows.append((None, None, "only", 5, 1, None, None))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    kept = lambda: {p for p in os.listdir(shared_dir(spark).removeprefix("file://")) if p.startswith("clustered")}
    before = kept()
    found = ti.top_items(df, ["g", "h"], "item", "score", ["first", "item"], 7, "place")
    assert kept() == before
    got = found.collect()
    assert sorted((str(r["g"]), r["h"], r["place"], r["item"]) for r in got) == _want(rows, 7)


def _stats(spark, df, path, rows_per_group):
    ti.cluster(df, path, rows_per_group)
    return pd.concat(ti.footers([pd.DataFrame({"path": spark.read.parquet(path).inputFiles()})]))


def test_row_groups_below_the_nth_score_are_skipped(spark, tmp_path):
    rows = [("a", f"i{i:05d}", i, 0) for i in range(40_000)]
    stats = _stats(spark, spark.createDataFrame(rows, "g string, item string, score bigint, t0 int"), f"file://{tmp_path}/c", 500)
    assert len(stats) > 70 and set(stats["unit"]) == {"ga"}
    done = ti.read_unit(stats, 10, ["t0"])
    assert sorted(done.rows["score"]) == list(range(39_990, 40_000)) and done.n_read <= 2


def test_equal_scores_do_not_read_the_whole_group(spark, tmp_path):
    # all scores and years alike, a text decides; and a third of the rows is one item
    rows = [("a", f"i{i:05d}", 5, 1, f"t{(i * 7919) % 30_000:05d}") for i in range(30_000)] + [("a", "again", 9, 1, "t")] * 10_000
    stats = _stats(spark, spark.createDataFrame(rows, "g string, item string, score bigint, t0 int, t1 string"), f"file://{tmp_path}/c", 500)
    done = ti.read_unit(stats, 10, ["t0", "t1"])
    assert sorted(done.rows["t1"]) == ["t", *(f"t{i:05d}" for i in range(9))] and done.n_read <= 4


def test_row_groups_of_several_groups_are_skipped_too(spark, tmp_path):
    # two runs of the same groups: the second holds lower scores only
    for part, least in (("x", 1000), ("y", 0)):
        rows = [(g, f"{part}{i}", least + i) for g in "abc" for i in range(100)]
        spark.createDataFrame(rows, "g string, item string, score bigint").coalesce(1).sortWithinPartitions("g", "score", ascending=[True, False]).write.parquet(f"{tmp_path}/{part}")
    stats = pd.concat(ti.footers([pd.DataFrame({"path": spark.read.parquet(f"file://{tmp_path}/x", f"file://{tmp_path}/y").inputFiles()})])).assign(unit="f")
    done = ti.read_unit(stats, 5, [])
    assert (done.n_row_groups, done.n_read) == (2, 1) and set(done.rows["score"]) == set(range(1095, 1100))


def test_large_numbers_and_no_numbers(spark):
    big = 2**53
    rows = [("a", "x", big, 1.0), ("a", "y", big + 1, float("nan")), ("a", "z", big + 1, 0.5), ("a", "n", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, item string, score bigint, w double")
    assert [r["item"] for r in sorted(ti.top_items(df, ["g"], "item", "score", ["w"], 2).collect(), key=lambda r: r["rank"])] == ["z", "y"]
    assert [r["item"] for r in ti.top_items(df, ["g"], "item", "w", [], 1).collect()] == ["n"]


def test_a_kept_layout_is_read_again(spark, tmp_path):
    df = spark.createDataFrame([("a", f"i{i}", i) for i in range(50)], "g string, item string, score bigint")
    keep = f"file://{tmp_path}/kept"
    first = ti.top_items(df, ["g"], "item", "score", [], 3, keep=keep).collect()
    assert ti.top_items(df.limit(0), ["g"], "item", "score", [], 3, keep=keep).collect() == first and len(first) == 3
    report = ti.row_group_report(df, ["g"], "item", "score", [], 3).first()
    assert report["n_row_groups"] == report["n_read"] + report["n_skipped"] > 0


def test_top_items_of_an_empty_table(spark):
    assert ti.top_items(spark.createDataFrame([], SCHEMA), ["g"], "item", "score", [], 3).collect() == []
    with pytest.raises(ValueError):
        ti.top_items(spark.createDataFrame([], SCHEMA), ["nope"], "item", "score", [], 3)
