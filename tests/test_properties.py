"""Properties of pure parts, over generated cases."""

from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from hanstrata.operators import dense_keys, lexicon
from hanstrata.operators import learner as L

KEYS = st.lists(st.one_of(st.none(), st.sampled_from(["a", "b", "", "가", "긴 열쇠"])), max_size=60)


@settings(max_examples=60, deadline=None)
@given(KEYS, st.integers(1, 5), st.integers(1, 7))
def test_blocks_add_up_to_counts(keys, n_blocks, step):
    kept = [k for k in keys if k is not None]
    block = [hash(k) % n_blocks for k in kept]
    batches = [
        pa.RecordBatch.from_pydict({"key": pa.array(kept[i : i + step], pa.string()), "block": pa.array(block[i : i + step], pa.int32()), "low": pa.array(range(i, i + len(kept[i : i + step])), pa.int64()), "high": pa.nulls(len(kept[i : i + step]), pa.int64())})
        for i in range(0, len(kept), step)
    ]
    parts = list(dense_keys._split_arrays(n_blocks)(iter(batches)))
    rows = [r for b in dense_keys._sum_blocks(iter(parts)) for r in b.to_pylist()]
    assert {r["key"]: r["n_rows"] for r in rows} == dict(Counter(kept))
    assert all(r["low"] == kept.index(r["key"]) and r["high"] is None for r in rows)


@settings(max_examples=80, deadline=None)
@given(st.text("ABCxＡ", max_size=20), st.sets(st.text("ABC", min_size=1, max_size=3), max_size=5))
def test_leftmost_longest_matches(text, keys):
    own = lexicon.Lexicon.build([{"idu_text": k, "hangul_text": "가"} for k in keys])
    form, want, i = text.replace("Ａ", "A"), [], 0
    while i < len(form):
        best = max((k for k in keys if form.startswith(k, i)), key=len, default=None)
        if best:
            want.append((i, i + len(best), best))
        i += len(best) if best else 1
    assert own.matches(text) == want


VOWELS = st.lists(st.sampled_from(list(L.SURFACE)), min_size=2, max_size=5)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(VOWELS, st.integers(1, 9)), min_size=1, max_size=12))
def test_learner_ends_and_its_counts_agree(words):
    rows = [(" ".join([v[0], *(L.V.TARGET_OF.get(x, x) for x in v[1:])]), " ".join(v), w) for v, w in words]
    data = L.merged(rows)
    for fit in (L.learn_progressive, L.learn_bidirectional):
        found = fit(data)
        assert found.trace[-1]["terminal_status"] in ("TP_PASS", "NO_NEW_REMOVABLE_CONTEXTS")
        for step in found.trace:
            failed = sum(e["weighted_count"] for e in found.events if (e["attempt_depth"], e["branch"], e["candidate_direction"]) == (step["attempt_depth"], step["branch"], step["selected_direction"]))
            assert failed == step["selected_prediction_exceptions"]
        if found.rule:
            n, m = found.rule.counts(data)
            assert L.productive(n, m) and m == sum(p["weighted_prediction_correct"] for p in L.pair_predictions(found.rule, data))
            assert 0 <= L.full_form_accuracy(found.rule, data) <= 1


def test_arrays_without_values():
    assert list(dense_keys._sum_blocks(iter([]))) == [] and np.iinfo(np.int64).max == dense_keys._LOW
