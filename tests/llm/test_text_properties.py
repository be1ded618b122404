"""Properties of the text operators over generated texts."""

import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hanstrata.llm import codepoints as cp
from hanstrata.llm import heavy_hitters, leakage, mixing, residue
from hanstrata.llm import visual_form as vf

TEXT = st.text(st.one_of(st.characters(codec="utf-8", exclude_categories=("Cs", "Co", "Cn")), st.sampled_from("가ᄀᆞéｶﾞ \n　​аΑ⽊")), max_size=40)
COMMON = settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@pytest.fixture(scope="module")
def table(spark):
    return vf.text_table(spark)


@COMMON
@given(TEXT)
def test_form_is_stable_and_blind_to_composition(table, text):
    (form,) = vf.canonical([text], table)
    assert vf.canonical([form], table) == [form]
    for kind in ("NFC", "NFD"):
        assert vf.canonical([unicodedata.normalize(kind, text)], table) == [form]


@COMMON
@given(st.lists(TEXT, max_size=6))
def test_texts_of_a_batch_do_not_touch(table, texts):
    assert vf.canonical(texts, table) == [vf.canonical([t], table)[0] for t in texts]


@COMMON
@given(st.lists(st.one_of(st.none(), TEXT), max_size=20), st.integers(1, 50))
def test_slices_are_the_batch(texts, size):
    batch, cp.BYTES_AT_ONCE = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())}), size
    try:
        assert [t for s in cp.slices([batch]) for t in s["text"].to_pylist()] == texts
    finally:
        cp.BYTES_AT_ONCE = 1 << 20


@COMMON
@given(st.lists(TEXT, max_size=5))
def test_grams_stay_within_texts(table, texts):
    points, offsets = leakage.letters(texts, table)
    _, at = leakage.grams(points, offsets)
    owner = np.searchsorted(offsets, at, side="right") - 1
    assert all(a + leakage.GRAM <= offsets[d + 1] for a, d in zip(at, owner, strict=True)) and len(at) == sum(max(0, n - leakage.GRAM + 1) for n in np.diff(offsets))


@COMMON
@given(st.lists(TEXT, max_size=5))
def test_windows_hold_all_letters(table, texts):
    w = residue.Windows(texts, table)
    hashes, window = w.grams()
    assert w.letters.sum() == len(hashes) == len(window) and (w.n == 0 or window.size == 0 or window.max() < w.n)


@COMMON
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(1, 20)), min_size=1, max_size=200))
def test_sketch_bounds_every_count(pairs):
    s, true = heavy_hitters.Sketch(0, heavy_hitters.BUCKETS), {}
    for v, n in pairs:
        h = np.array([v * heavy_hitters.COUNTERS + v % 3], np.int64)  # three buckets for all
        s.add(h, np.array([str(v)], object), np.array([n], np.int64))
        true[str(v)] = true.get(str(v), 0) + n
    cells = dict(zip(s.value, s.votes, strict=True))
    for v, n in true.items():
        light = s.light[int(v) % 3]
        assert cells.get(v, 0) <= n <= cells.get(v, 0) + light
    assert s.votes.sum() + s.light.sum() == sum(true.values())


@COMMON
@given(st.integers(1, 500), st.integers(0, 1 << 30))
def test_permutations(n, key):
    assert sorted(mixing.permuted(np.arange(n), n, key).tolist()) == list(range(n))


@COMMON
@given(st.lists(st.floats(0.01, 1), min_size=1, max_size=8), st.integers(0, 2000), st.integers(0, 100))
def test_shards_are_filled(shares, slots, seed):
    p = np.array(shares) / sum(shares)
    n = mixing.shard_counts(p, slots, np.random.default_rng(seed))
    assert n.sum() == slots and (np.abs(n - p * slots) <= len(p) + 1).all()
