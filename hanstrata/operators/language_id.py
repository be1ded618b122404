"""Language identification by any trained model that gives a logit for each of its labels.

A model is loaded once for each Python worker, however many label sets are asked of it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What models of this kind put before a label.
PREFIX = "__label__"
UNKNOWN = "UNK"


class Model(Protocol):
    labels: list[str]

    def logits(self, text: str) -> np.ndarray: ...


#: Features of a Letters model; letter n-grams are hashed to them.
FEATURES = 1 << 16


class Letters:
    """A small identifier by n-grams of one to four letters with the edges of words: the model that this library trains itself.

    It is multinomial: a label's weight of an n-gram is the logarithm of its share among the label's
    n-grams. Kept as one file (save, load).
    """

    def __init__(self, labels: list[str], weights: np.ndarray, prior: np.ndarray):
        self.labels, self.weights, self.prior = labels, weights, prior

    @staticmethod
    def features(text: str) -> np.ndarray:
        whole = f" {one_line(text).lower()} "
        # of a fixed hash, as a model outlives the process
        return np.array([zlib.crc32(whole[i : i + n].encode("utf-8", "surrogatepass")) % FEATURES for n in (1, 2, 3, 4) for i in range(len(whole) - n + 1)], np.int64)

    @classmethod
    def train(cls, texts: list[str], labels: list[str]) -> Letters:
        """From labelled texts: those of a sample that the caller bounds."""
        names = sorted(set(labels))
        counts = np.full((len(names), FEATURES), 0.05)
        for text, label in zip(texts, labels, strict=True):
            np.add.at(counts[names.index(label)], cls.features(text), 1)
        prior = np.log(np.array([labels.count(x) for x in names]) / max(1, len(labels)))
        return cls(names, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32), prior)

    def logits(self, text: str) -> np.ndarray:
        found = self.features(text)
        # a mean, so that long texts aren't told beyond all doubt by n-grams that depend on each other
        return self.prior + self.weights[:, found].sum(axis=1) / np.sqrt(max(1, len(found)))

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            np.savez_compressed(f, labels=np.array(self.labels), weights=self.weights, prior=self.prior)

    @classmethod
    def load(cls, path: str) -> Letters:
        with np.load(path) as saved:
            return cls(saved["labels"].tolist(), saved["weights"], saved["prior"])


def labelled_sample(docs: DataFrame, names: DataFrame, per_label: int = 200, characters: int = 4000) -> tuple[list[str], list[str]]:
    """Texts and labels to train on: of each label at most `per_label` documents of at most `characters` letters, by hash of the text.

    `docs` has text and language, `names` (language_label, language) the known spellings of labels.
    """
    known = names.select(F.lower(F.trim("language_label")).alias("spelling"), F.col("language").alias("named")).dropDuplicates(["spelling"])
    rows = docs.where((F.length("text") > 0) & (F.length("text") <= characters)).select("text", F.lower(F.trim("language")).alias("spelling")).join(F.broadcast(known), "spelling")
    place = F.row_number().over(W.partitionBy("named").orderBy(F.xxhash64("text"), "text"))
    sample = rows.select("named", "text").distinct().withColumn("place", place).where(F.col("place") <= per_label).orderBy("named", "place").collect()
    return [r["text"] for r in sample], [r["named"] for r in sample]


@dataclass(frozen=True)
class saved:  # noqa: N801
    """What identify() and all_labels() take for a model file that every worker can read; equal paths are one model in a worker."""

    path: str

    def __call__(self) -> Model:
        return Letters.load(self.path)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def one_line(text: str) -> str:
    """White space collapsed: models read one line."""
    return " ".join(text.split())


def best(model: Model, text: str | None) -> str:
    """The most probable of all labels, without its prefix; UNK for null and blank texts."""
    line = one_line(text or "")
    if not line or not len(model.labels):
        return UNKNOWN
    return model.labels[int(np.argmax(model.logits(line)))].removeprefix(PREFIX)


def among(model: Model, text: str | None, labels: tuple[str, ...], mode: str = "before", k: int = 1) -> list[tuple[str, float]]:
    """The k most probable of some labels, with their scores; ties by the order of `labels`.

    With mode `before` only these labels share the probability; with `after` all labels do, so the
    scores add up to less than 1. A label that the model lacks raises ValueError. Null and blank
    texts give nothing.
    """
    if mode not in ("before", "after"):
        raise ValueError("mode is before or after")
    place = {x.removeprefix(PREFIX): i for i, x in enumerate(model.labels)}
    if missing := [x for x in labels if x not in place]:
        raise ValueError(f"the model has no label {', '.join(missing)}")
    line = one_line(text or "")
    if not line:
        return []
    at, logits = [place[x] for x in labels], np.asarray(model.logits(line), float)
    score = softmax(logits[at]) if mode == "before" else softmax(logits)[at]
    order = np.argsort(-score, kind="stable")[:k]
    return [(labels[i], float(score[i])) for i in order]


@lru_cache(maxsize=4)
def _loaded(load: Callable[[], Model]) -> Model:
    return load()


def identify(load: Callable[[], Model], labels: tuple[str, ...], mode: str = "before") -> Callable[[Column, object], Column]:
    """A function for documents.profile(): struct(language, score) of a text, among `labels`.

    `load` is a module-level function that gives the model; each worker calls it once.
    """

    @F.pandas_udf(T.StructType([T.StructField("language", T.StringType()), T.StructField("score", T.DoubleType())]))
    def identified(text: pd.Series) -> pd.DataFrame:
        model = _loaded(load)
        found = [(among(model, t, labels, mode) or [(None, None)])[0] for t in text]
        return pd.DataFrame(found, columns=["language", "score"])

    return lambda text, script, words: identified(text)


def all_labels(load: Callable[[], Model]) -> Callable[[Column], Column]:
    """A column function: the most probable of all labels."""

    @F.pandas_udf(T.StringType())
    def identified(text: pd.Series) -> pd.Series:
        model = _loaded(load)
        return text.map(lambda t: best(model, t))

    return identified
