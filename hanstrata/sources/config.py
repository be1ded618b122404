"""Run settings: JSON files with overrides, checked before any job runs, and echoed beside the results."""

from __future__ import annotations

import argparse
import dataclasses
import json
from pathlib import Path
from typing import TypeVar

from hanstrata.operators.sampling import Sampling
from hanstrata.operators.tokens import Extraction
from hanstrata.runtime import read_json

S = TypeVar("S")

#: Names of two-year bounds in files, and the settings that they belong to.
BOUNDS = {"arae_noninitial_merger": "arae_noninitial_merger", "arae_initial_merger": "arae_initial_merger", "lmk_emk_transition": "lmk_emk_transition"}


@dataclasses.dataclass(frozen=True)
class Preprocessing:
    input_dir: str = "raw_data"
    output_dir: str = "analysis/data"
    input_patterns: tuple[str, ...] = ("*.jsonl", "*.jsonl.gz")
    skip_existing_output: bool = True


@dataclasses.dataclass(frozen=True)
class Pairs:
    """Settings of the pair stage; other inventories than the core are not defined."""

    window_id_col: str = "time_window_id"
    vowel_seq_col: str = "vowel_seq"
    wordform_id_col: str = "wordform_id"
    token_col: str = "token"
    core_only: bool = True
    min_vowels: int = 2
    write_window_pair_files: bool = True

    def __post_init__(self):
        if not self.core_only:
            raise ValueError("only the core inventory can be converted: core_only must be true")
        if self.min_vowels < 1:
            raise ValueError("min_vowels is positive")


@dataclasses.dataclass(frozen=True)
class Baseline:
    window_id_col: str = "time_window_id"
    vowel_seq_col: str = "d2l_sr"
    initial_i_policy: str = "unscored"
    write_wordform_details: bool = True

    def __post_init__(self):
        if self.initial_i_policy not in ("unscored", "minus-rtr"):
            raise ValueError("initial_i_policy is unscored or minus-rtr")


@dataclasses.dataclass(frozen=True)
class Learning:
    window_id_col: str = "time_window_id"
    ur_col: str = "d2l_ur"
    sr_col: str = "d2l_sr"
    weight_col: str = "lexical_type_weight"
    mode: str = "progressive"
    write_pair_predictions: bool = True


def load(kind: type[S], path: str | Path | None = None, required: tuple[str, ...] = (), **overrides) -> S:
    """Settings from a JSON file and overrides, which win; unknown keys of the file are passed over.

    A pair of keys name_start and name_end of a file is the setting `name`. Raises ValueError for
    a required key that is missing and for an unknown override.
    """
    given = read_json(path) if path else {}
    missing = [k for k in required if k not in given and k not in overrides]
    if missing:
        raise ValueError(f"missing settings: {', '.join(missing)}")
    fields = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := [k for k in overrides if k not in fields]:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    values = {k: v for k, v in given.items() if k in fields}
    for name in BOUNDS:
        if name in fields and f"{name}_start" in given:
            values[name] = (given[f"{name}_start"], given[f"{name}_end"])
    values |= overrides
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def from_command_line(kind: type[S], argv: list[str] | None = None, required: tuple[str, ...] = ()) -> S:
    """Settings from --config FILE and a flag for each setting; only flags that are given override the file."""
    parser = argparse.ArgumentParser(argument_default=argparse.SUPPRESS)
    parser.add_argument("--config", default=None)
    for f in dataclasses.fields(kind):
        flag = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            parser.add_argument(flag, action=argparse.BooleanOptionalAction)
        elif isinstance(f.default, tuple):
            parser.add_argument(flag, nargs="*", type=type(f.default[0]) if f.default else str)
        else:
            parser.add_argument(flag, type=int if isinstance(f.default, int) or f.name.startswith(("max_", "start_")) else str)
    given = vars(parser.parse_args(argv))
    return load(kind, given.pop("config"), required, **given)


def as_json(settings, **derived) -> str:
    """The settings that a run had, and what followed from them, as JSON."""
    out = dataclasses.asdict(settings) | derived
    if isinstance(settings, Sampling):
        out["window_overlap_years"] = max(0, settings.window_width - settings.window_step)
    return json.dumps(out, ensure_ascii=False, indent=2)


def echo(settings, path: str | Path, **derived) -> None:
    """Writes as_json to a local file."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(as_json(settings, **derived), encoding="utf-8")


__all__ = ["Baseline", "Extraction", "Learning", "Pairs", "Preprocessing", "Sampling", "as_json", "echo", "from_command_line", "load"]
