"""The learner on small vectors, and on a published run if there is one."""

import csv
import glob
import os

import pytest

from hanstrata.operators import learner as L

#: A folder with the results of a published run, for those who have one.
RUN = os.environ.get("PUBLISHED_RUN", "")
needs_runs = pytest.mark.skipif(not os.path.isdir(RUN), reason="PUBLISHED_RUN names no folder")


def pairs(text):
    return L.merged(tuple(x.strip() for x in line.split("|")) for line in text.strip().splitlines())


def test_projection_keeps_the_first_segment():
    tier = L.Tier(L.INVENTORY - {"ㅣ"}, "t", "k")
    rule = L.Rule(frozenset({"A"}), frozenset(), tier)
    assert rule.places(("ㅏ", "ㅣ", "A")) == [0, 2] and rule.places(("ㅣ", "ㅏ", "A")) == [0, 1, 2] and rule.places(("ㅣ", "ㅣ", "A")) == [0, 2]


def test_transparent_vowel_leaves_the_tier():
    rows = [("ㅏ A", "ㅏ ㅏ"), ("ㅓ EO", "ㅓ ㅓ"), ("ㅗ O", "ㅗ ㅗ"), ("ㅜ U", "ㅜ ㅜ"), ("ㅏ EO", "ㅏ ㅏ"), ("ㅓ A", "ㅓ ㅓ"), ("ㅗ U", "ㅗ ㅗ"), ("ㅜ O", "ㅜ ㅜ"), ("ㅏ ㅣ A", "ㅏ ㅣ ㅏ"), ("ㅗ ㅣ O", "ㅗ ㅣ ㅗ"), ("ㅏ ㅣ EO", "ㅏ ㅣ ㅏ"), ("ㅗ ㅣ U", "ㅗ ㅣ ㅗ"), ("ㅓ ㅣ EO", "ㅓ ㅣ ㅓ")]
    data = L.merged((u, s, 10) for u, s in rows)
    first = L.Rule(L.alternating(data), L._contexts(data, L.alternating(data), None, L.L2R))
    assert {e["context_segment"] for e in L.errors(first, data)} == {"ㅣ"}
    found = L.learn_progressive(data)
    assert [t["terminal_status"] for t in found.trace] == ["RECURSE", "TP_PASS"]
    assert found.trace[0]["chosen_natural_class"] == "[+front]" and "ㅣ" not in found.rule.tier.segments
    n, m = found.rule.counts(data)
    assert n == m == 130 and L.full_form_accuracy(found.rule, data) == 1.0
    both = L.learn_bidirectional(data)
    assert both.rule is not None and both.rule.harmony


def test_bad_weights_and_nothing():
    with pytest.raises(ValueError):
        L.merged([("ㅏ A", "ㅏ ㅏ", 0)])
    with pytest.raises(ValueError):
        L.merged([])


def _window(name):
    with open(f"{RUN}/d2l_core/window_pairs/{name}.tsv", encoding="utf-8") as f:
        return L.merged(tuple(line.rstrip("\n").split("\t")) for line in f)


def _table(name):
    with open(f"{RUN}/d2l_results_progressive_protected/{name}.csv", encoding="utf-8-sig") as f:
        return list(csv.DictReader(f))


@needs_runs
def test_published_traces():
    steps = _table("d2l_learning_trace")
    for window in {s["time_window_id"] for s in steps}:
        mine = L.learn_progressive(_window(window)).trace
        theirs = sorted((s for s in steps if s["time_window_id"] == window), key=lambda s: int(s["attempt_depth"]))
        assert len(mine) == len(theirs)
        for a, b in zip(mine, theirs, strict=True):
            assert (a["selected_prediction_N"], a["selected_prediction_exceptions"], a["terminal_status"]) == (int(b["selected_prediction_N"]), int(b["selected_prediction_exceptions"]), b["terminal_status"])
            for k in ("left_contexts", "delset_after", "all_errant_contexts", "eligible_errant_contexts"):
                assert set(a[k].split()) == set(b[k].replace(",", " ").split()), (window, k)


@needs_runs
def test_published_failure_contexts():
    published = {}
    for r in _table("d2l_failure_context_summary"):
        published[r["time_window_id"], int(r["attempt_depth"]), r["context_segment"], r["context_source"]] = (int(r["structural_failed_predictions"]), int(r["weighted_failed_predictions"]))
    mine = {}
    for path in glob.glob(f"{RUN}/d2l_core/window_pairs/*.tsv"):
        window = os.path.basename(path)[:-4]
        for e in L.learn_progressive(_window(window)).events:
            key = window, e["attempt_depth"], e["context_segment"], e["context_source"]
            n, w = mine.get(key, (0, 0))
            mine[key] = n + 1, w + e["weighted_count"]
    assert mine == published
