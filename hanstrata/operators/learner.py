"""The rule and tier learner, in plain Python: one window's pairs in, a rule and its diagnostics out.

A rule predicts abstract vowels from the nearest segment on its tier, in one direction; each
prediction is the context of the next. If a rule has more exceptions than the tolerance threshold
allows, segments that misled it leave the tier, and learning starts again.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field, replace

from hanstrata.functions import inventory as V

LEFT_EDGE, RIGHT_EDGE = "⋊", "⋉"
L2R, R2L = "left_to_right", "right_to_left"


class Inventory:
    """The segments that may occur, and their features. Abstract targets have the features of their pair, but no value of RTR."""

    def __init__(self, segments: dict[str, dict[str, str]] = V.SEGMENTS):
        if missing := sorted({s for pair in V.TARGET_PAIRS.values() for s in pair} - set(segments)):
            raise ValueError(f"segments without features: {' '.join(missing)}")
        if any("RTR" not in values for values in segments.values()):
            raise ValueError("each segment needs a value of RTR")
        self.surface = tuple(segments)
        self.names = tuple(dict.fromkeys(f for values in segments.values() for f in values))
        self.features = segments | {t: {f: v for f, v in segments[pair[0]].items() if f != "RTR"} for t, pair in V.TARGET_PAIRS.items()}
        self.members = frozenset(self.features)

    def value(self, segment: str) -> str | None:
        return self.features.get(segment, {}).get("RTR")


CORE = Inventory()
INVENTORY, SURFACE = CORE.members, CORE.surface
Pair = tuple[tuple[str, ...], tuple[str, ...]]


def tolerance(n: int) -> float | None:
    return n / math.log(n) if n > 1 else None


def productive(n: int, correct: int) -> bool:
    return n > 1 and correct > 1 and correct >= n / 2 and n - correct <= tolerance(n)


def joined(symbols) -> str:
    return " ".join(sorted(symbols))


@dataclass(frozen=True)
class Tier:
    """The segments that a rule sees, and how they were chosen."""

    segments: frozenset[str]
    name: str
    kind: str
    protect_first: bool = True


@dataclass(frozen=True)
class Rule:
    targets: frozenset[str]
    contexts: frozenset[str]
    tier: Tier | None = None
    default: str | None = None
    direction: str = L2R
    harmony: bool = True
    inventory: Inventory = field(default=CORE, compare=False, repr=False)

    def places(self, ur: tuple[str, ...]) -> list[int]:
        """Indices of the segments on the tier."""
        if self.tier is None:
            return list(range(len(ur)))
        return [i for i, s in enumerate(ur) if s in self.tier.segments or (i == 0 and self.tier.protect_first)]

    def _value(self, context: str) -> str | None:
        value = self.inventory.value(context)
        if value is None or self.harmony:
            return value
        return "-" if value == "+" else "+"

    def predict(self, ur: tuple[str, ...]):
        """(place, context place or None, context, rule used?, predicted, source) of each target, in the rule's direction."""
        now, places = list(ur), self.places(ur)
        solved: dict[int, tuple[str, str]] = {}
        steps = range(len(places)) if self.direction == L2R else range(len(places) - 1, -1, -1)
        for k in steps:
            i = places[k]
            if ur[i] not in self.targets:
                continue
            near = k - 1 if self.direction == L2R else k + 1
            j = places[near] if 0 <= near < len(places) else None
            context = now[j] if j is not None else LEFT_EDGE if self.direction == L2R else RIGHT_EDGE
            used = context in self.contexts
            value = self._value(context) if used else self.default
            predicted = ur[i] if value is None else V.TARGET_PAIRS[ur[i]][0 if value == "+" else 1]
            source = "BOUNDARY" if j is None else "RESOLVED_TARGET_CONTEXT" if j in solved else "UNRESOLVED_TARGET_CONTEXT" if ur[j] in self.targets else "ORIGINAL_SPECIFIED_CONTEXT"
            yield i, j, context, used, predicted, source
            solved[i] = ur[i], predicted
            now[i] = predicted

    def produce(self, ur: tuple[str, ...]) -> tuple[str, ...]:
        out = list(ur)
        for i, _, _, _, predicted, _ in self.predict(ur):
            out[i] = predicted
        return tuple(out)

    def counts(self, pairs: dict[Pair, int]) -> tuple[int, int]:
        """Weighted predictions, and correct ones."""
        n = m = 0
        for (ur, sr), weight in pairs.items():
            for i, _, _, _, predicted, _ in self.predict(ur):
                n += weight
                m += weight * (predicted == sr[i])
        return n, m

    def __str__(self) -> str:
        kind = "harmony" if self.harmony else "disharmony"
        return f"{{{joined(self.targets)}}} RTR {kind} {self.direction} after {{{joined(self.contexts)}}} on {self.tier.name if self.tier else 'NONE'}, else {self.default or 'none'}RTR"


@dataclass
class Learned:
    rule: Rule | None = None
    trace: list[dict] = field(default_factory=list)
    events: list[dict] = field(default_factory=list)


def merged(rows) -> dict[Pair, int]:
    """Pairs with their weights; equal pairs add up. Raises ValueError for none, or a weight of 0 or less."""
    out: Counter = Counter()
    for ur, sr, weight in rows:
        if int(weight) <= 0:
            raise ValueError(f"weights are positive; there is {weight}")
        out[tuple(ur.split()), tuple(sr.split())] += int(weight)
    if not out:
        raise ValueError("there are no pairs to learn from")
    return dict(sorted(out.items()))


def _with_default(rule: Rule, pairs: dict[Pair, int]) -> Rule:
    """The rule with a default: the value of the most frequent surface segment among targets that it leaves open."""
    open_targets: Counter = Counter()
    for (ur, sr), weight in pairs.items():
        for segment, surface in zip(rule.produce(ur), sr, strict=True):
            if segment in rule.targets:
                open_targets[surface] += weight
    if not open_targets:
        return rule
    best = min(open_targets.items(), key=lambda p: (-p[1], p[0]))[0]
    return replace(rule, default=rule.inventory.value(best))


def _contexts(pairs: dict[Pair, int], targets: frozenset[str], tier: Tier | None, direction: str) -> frozenset[str]:
    """Segments next to a target on the tier, before any is resolved."""
    probe = Rule(targets, frozenset(), tier, None, direction)
    out = set()
    for ur, _ in pairs:
        places = probe.places(ur)
        for a, b in zip(places, places[1:], strict=False):
            here, near = (b, a) if direction == L2R else (a, b)
            if ur[here] in targets:
                out.add(ur[near])
    return frozenset(out)


def errors(rule: Rule, pairs: dict[Pair, int]) -> list[dict]:
    """What went wrong, prediction by prediction."""
    out = []
    for (ur, sr), weight in pairs.items():
        right: dict[int, bool] = {}
        for i, j, context, used, predicted, source in rule.predict(ur):
            right[i] = predicted == sr[i]
            if right[i]:
                continue
            resolved, abstract = source == "RESOLVED_TARGET_CONTEXT", context in rule.targets
            out.append({
                "d2l_ur": " ".join(ur), "d2l_sr": " ".join(sr), "lexical_type_weight": weight, "direction": rule.direction, "harmony_type": "harmony" if rule.harmony else "disharmony", "tier": rule.tier.name if rule.tier else "NONE",
                "target_index": i, "target_abstract_segment": ur[i], "actual_surface_segment": sr[i], "predicted_surface_segment": predicted, "correct": False, "weighted_count": weight,
                "context_segment": context, "context_index": j, "context_source": source, "original_context_symbol": ur[j] if j is not None else None,
                "context_was_resolved_target": resolved, "previous_target_prediction_correct": right[j] if resolved else None, "context_was_prior_misprediction": resolved and not right[j],
                "used_rule_context": used, "used_default": not used, "context_is_protected_abstract_target": abstract, "context_is_protected_initial_position": j == 0, "context_is_boundary": j is None,
                "eligible_for_delset_under_current_rule": used and j is not None and not abstract and j != 0,
            })
    return out


def feature_classes(segments: set[str], targets: frozenset[str], inventory: Inventory = CORE) -> dict[str, frozenset[str]]:
    """Classes of a single feature value that all of the segments have and no target has, with all their members."""
    out = {}
    for f in inventory.names:
        for value in "+-":
            members = frozenset(s for s in inventory.members if inventory.features[s].get(f) == value)
            if segments <= members and not members & targets:
                out[f"[{value}{f}]"] = members
    return out


def choose_tier(removed: set[str], targets: frozenset[str], protect_first: bool, inventory: Inventory = CORE) -> tuple[Tier, str, str]:
    """(tier, all classes, chosen class) without the removed segments: by the smallest natural class, if there is one."""
    suffix = "_INITIAL_PROTECTED" if protect_first else ""
    options, every = feature_classes(removed, targets, inventory), inventory.members
    listed = " || ".join(sorted(options))
    if not options:
        return Tier(every - removed, f"{{{joined(every - removed)}}}", f"EXPLICIT_SEGMENT_COMPLEMENT{suffix}", protect_first), listed, ""
    best = min(options, key=lambda k: (len(options[k]), k))
    opposite = f"[{'-' if best[1] == '+' else '+'}{best[2:-1]}]"
    others = frozenset(s for s in every if inventory.features[s].get(best[2:-1]) == opposite[1])
    if every - options[best] == others:
        return Tier(others, opposite, f"NATURAL_CLASS_COMPLEMENT{suffix}", protect_first), listed, best
    return Tier(every - options[best], f"¬{best}", f"NATURAL_CLASS_DELETION{suffix}", protect_first), listed, best


def alternating(pairs: dict[Pair, int]) -> frozenset[str]:
    """Underlying segments that ever surface as another one."""
    return frozenset(u for ur, sr in pairs for u, s in zip(ur, sr, strict=True) if u != s)


def learn_progressive(pairs: dict[Pair, int], inventory: Inventory = CORE) -> Learned:
    """Left-to-right harmony; the first segment is always on the tier."""
    targets, out = alternating(pairs), Learned()
    tier, removed, depth = None, frozenset(), 0
    while True:
        rule = _with_default(Rule(targets, _contexts(pairs, targets, tier, L2R), tier, inventory=inventory), pairs)
        n, m = rule.counts(pairs)
        wrong = errors(rule, pairs)
        out.events += [e | {"branch": "harmony", "attempt_depth": depth, "candidate_direction": L2R, "selected_candidate": True} for e in wrong]
        misled = {e["context_segment"] for e in wrong if e["eligible_for_delset_under_current_rule"]}
        step = {
            "branch": "harmony", "attempt_depth": depth, "tier_before": tier.name if tier else "NONE", "delset_before": joined(removed), "target_segments": joined(targets), "left_contexts": joined(rule.contexts),
            "selected_direction": L2R, "selected_prediction_N": n, "selected_prediction_correct": m, "selected_prediction_exceptions": n - m, "selected_accuracy": m / n if n else 0.0, "theta_N": tolerance(n), "TP_pass": productive(n, m),
            "default": f"RTR {rule.default}" if rule.default else "", "all_errant_contexts": joined({e["context_segment"] for e in wrong if not e["context_is_boundary"]}), "eligible_errant_contexts": joined(misled),
            "new_delset_segments": "", "delset_after": "", "tier_candidate_type": "", "tier_after": tier.name if tier else "NONE", "natural_class_options": "", "chosen_natural_class": "",
        }
        out.trace.append(step)
        if productive(n, m):
            step["terminal_status"] = "TP_PASS"
            out.rule = rule
            return out
        after = (removed | misled) - targets
        step |= {"new_delset_segments": joined(after - removed), "delset_after": joined(after)}
        if after == removed:
            step["terminal_status"] = "NO_NEW_REMOVABLE_CONTEXTS"
            return out
        tier, listed, chosen = choose_tier(set(after), targets, True, inventory)
        step |= {"terminal_status": "RECURSE", "tier_candidate_type": tier.kind, "tier_after": tier.name, "natural_class_options": listed, "chosen_natural_class": chosen}
        removed, depth = after, depth + 1


def learn_bidirectional(pairs: dict[Pair, int], inventory: Inventory = CORE) -> Learned:
    """Both directions and both kinds, without protection of the first segment; the more accurate branch wins, harmony on a tie."""
    branches = [_branch(pairs, harmony, inventory) for harmony in (True, False)]
    out = Learned(None, [t for b in branches for t in b.trace], [e for b in branches for e in b.events])
    rules = [b.rule for b in branches if b.rule]
    if rules:
        accuracy = lambda r: (lambda n, m: m / n if n else 0.0)(*r.counts(pairs))
        out.rule = max(rules, key=accuracy)  # the first of equals
    return out


def _branch(pairs: dict[Pair, int], harmony: bool, inventory: Inventory) -> Learned:
    targets, out = alternating(pairs), Learned()
    tier, removed, depth, name = None, frozenset(), 0, "harmony" if harmony else "disharmony"
    while True:
        tried = {d: _with_default(Rule(targets, _contexts(pairs, targets, tier, d), tier, None, d, harmony, inventory), pairs) for d in (L2R, R2L)}
        counts = {d: r.counts(pairs) for d, r in tried.items()}
        accuracy = {d: m / n if n else 0.0 for d, (n, m) in counts.items()}
        best = L2R if accuracy[L2R] >= accuracy[R2L] else R2L
        for d, r in tried.items():
            out.events += [e | {"branch": name, "attempt_depth": depth, "candidate_direction": d, "selected_candidate": d == best} for e in errors(r, pairs)]
        rule, (n, m) = tried[best], counts[best]
        wrong = [e for e in errors(rule, pairs) if e["used_rule_context"] and not e["context_is_boundary"]]
        step = {
            "branch": name, "attempt_depth": depth, "tier_before": tier.name if tier else "NONE", "delset_before": joined(removed), "target_segments": joined(targets), "left_contexts": joined(tried[L2R].contexts), "right_contexts": joined(tried[R2L].contexts),
            "selected_direction": best, "selected_prediction_N": n, "selected_prediction_correct": m, "selected_prediction_exceptions": n - m, "selected_accuracy": accuracy[best], "theta_N": tolerance(n), "TP_pass": productive(n, m),
            "default": f"RTR {rule.default}" if rule.default else "", "all_errant_contexts": joined({e["context_segment"] for e in wrong}), "eligible_errant_contexts": joined({e["context_segment"] for e in wrong} - targets),
            "new_delset_segments": "", "delset_after": "", "tier_candidate_type": "", "tier_after": tier.name if tier else "NONE", "natural_class_options": "", "chosen_natural_class": "",
        }
        out.trace.append(step)
        if productive(n, m):
            if tier is not None:  # any segment of the tier may be a context, unless that costs accuracy
                wide = replace(rule, contexts=tier.segments)
                wn, wm = wide.counts(pairs)
                rule = wide if wn and wm / wn >= accuracy[best] else rule
            step["terminal_status"], out.rule = "TP_PASS", rule
            return out
        after = (removed | {e["context_segment"] for e in wrong}) - targets
        step |= {"new_delset_segments": joined(after - removed), "delset_after": joined(after)}
        if after == removed:
            step["terminal_status"] = "NO_NEW_REMOVABLE_CONTEXTS"
            return out
        tier, listed, chosen = choose_tier(set(after), targets, False, inventory)
        step |= {"terminal_status": "RECURSE", "tier_candidate_type": tier.kind, "tier_after": tier.name, "natural_class_options": listed, "chosen_natural_class": chosen}
        removed, depth = after, depth + 1


def full_form_accuracy(rule: Rule, pairs: dict[Pair, int]) -> float:
    total = sum(pairs.values())
    return sum(w for (ur, sr), w in pairs.items() if rule.produce(ur) == sr) / total if total else 0.0


def pair_predictions(rule: Rule, pairs: dict[Pair, int]) -> list[dict]:
    """What the rule predicts for each pair, per lexical type and weighted."""
    out = []
    for (ur, sr), weight in sorted(pairs.items(), key=lambda p: (" ".join(p[0][0]), " ".join(p[0][1]))):
        n, m = rule.counts({(ur, sr): 1})
        form = rule.produce(ur)
        out.append({
            "d2l_ur": " ".join(ur), "d2l_sr": " ".join(sr), "predicted_sr": " ".join(form), "lexical_type_weight": weight, "pair_full_form_correct": form == sr,
            "prediction_N_per_lexical_type": n, "prediction_correct_per_lexical_type": m, "prediction_exceptions_per_lexical_type": n - m,
            "weighted_prediction_N": n * weight, "weighted_prediction_correct": m * weight, "weighted_prediction_exceptions": (n - m) * weight,
        })
    return out


def surface_on_tier(rule: Rule | None) -> tuple[str, str]:
    """Surface segments on the rule's tier, and those that are not, each joined by blanks."""
    if rule is None:
        return "", ""
    surface = rule.inventory.surface
    on = [s for s in surface if rule.tier is None or s in rule.tier.segments]
    return " ".join(on), " ".join(s for s in surface if s not in on)
