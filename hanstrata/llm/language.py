"""Language of documents, of their lines, and of parts of lines, by a linear-chain conditional random field.

Words are labelled in the order of their line. What a word says follows from its affixes, letter
n-grams, scripts and its entry in the lexicon, all hashed to one weight table; how languages follow
each other within a line is a learned matrix of transitions. Forward-backward gives each word's
distribution. A line is in the language of most of its letters, those of brackets aside; a
document in that of most of its letters; runs of words of one language are the parts of a line.

The model is fitted on a bounded sample of labelled rows (SampleBounds); labels may be wrong in
part: lines that a first fit contradicts are left out of the second. Labels of documents tell nothing
of switches within a line, so trusted lines of different languages are joined to sequences that have
them: transitions are learned from these. Fits of different folds run as tasks of their own.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hanstrata.llm import codepoints as cp
from hanstrata.llm.visual_form import canonical, text_table
from hanstrata.runtime import require_columns

FEATURES = 1 << 17
#: Weight of words in brackets and quotation marks for the language of a line.
BRACKETED = 0.05
#: Of neighbouring sample lines in different languages, one in so many is joined to the one before.
JOINED = 3
_OPEN, _CLOSE = "(（「『《〈[【［“‘{<", ")）」』》〉]】］”’}>"
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class SampleBounds:
    """How many labelled documents the model is fitted on, how long they may be, and how they are used.

    Of a language with fewer trusted sample lines than `few_lines`, they are not judged a second time.
    """

    documents_per_language: int = 300
    characters: int = 4000
    rounds: tuple[int, int] = (20, 40)
    folds: int = 3
    few_lines: int = 100


def _hash(*parts) -> np.ndarray:
    h = np.zeros(1, np.uint64)
    for p in parts:
        h = (h + np.atleast_1d(p).astype(np.uint64) + np.uint64(1)) * _MIX
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(20)).astype(np.int64) % FEATURES


class Words:
    """The words of texts, their lines, and their hashed features."""

    def __init__(self, texts: list[str], to: np.ndarray):
        forms = [f if len(low := f.lower()) != len(f) else low for f in canonical(texts, to)]
        #: the same for texts that look the same
        self.text_key = np.array([zlib.crc32("".join(f.split()).encode()) for f in forms])
        points, offsets = cp.explode(forms)
        n = len(points)
        letter = cp.is_letter()[points]
        word_char = letter | (cp.categories()[points] == ord("M"))
        first_of_text = np.zeros(n + 1, bool)
        first_of_text[offsets] = True
        line_start = first_of_text[:-1] | np.append(False, points[:-1] == 10)[:n]
        line = np.cumsum(line_start) - 1
        #: text and number of each line; a text without characters has no line here
        at = np.flatnonzero(line_start)
        self.line_text = np.searchsorted(offsets, at, side="right") - 1
        self.line_no = np.arange(len(at)) - np.searchsorted(self.line_text, self.line_text) + 1
        self.n_texts, self.n_lines = len(texts), len(at)
        start = word_char & ~np.append(False, word_char[:-1] & ~line_start[1:])[:n]
        inside = np.flatnonzero(word_char)
        word = (np.cumsum(start) - 1)[inside]
        self.n = int(start.sum())
        self.line = line[np.flatnonzero(start)]
        self.letters = np.bincount(word, weights=letter[inside], minlength=self.n)
        depth = np.isin(points, [ord(c) for c in _OPEN]).astype(np.int64) - np.isin(points, [ord(c) for c in _CLOSE])
        total = np.cumsum(depth)
        base = np.append(0, total)[at][line] if n else total
        self.bracketed = ((total - base) > 0)[np.flatnonzero(start)]
        # n-grams of one to three characters, with the word's edges
        p = points[inside].astype(np.uint64)
        same = np.append(False, word[1:] == word[:-1]) if len(word) else np.zeros(0, bool)
        before = np.where(same, np.append(np.uint64(0), p[:-1])[: len(p)], np.uint64(3))
        before2 = np.where(same & np.append(False, same[:-1])[: len(same)], np.append(np.zeros(2, np.uint64), p[:-2])[: len(p)], np.uint64(3))
        ends = np.flatnonzero(np.append(word[1:] != word[:-1], True)) if len(word) else np.zeros(0, np.int64)
        block = cp.blocks()[points[inside]]
        scripts = np.zeros(self.n, np.int64)
        np.bitwise_or.at(scripts, word, np.left_shift(1, block.astype(np.int64)))
        self.scripts = scripts
        lexicon = np.zeros(self.n, np.uint64)
        if len(ends):  # a polynomial hash of the whole word
            place = np.arange(len(word)) - np.append(0, ends[:-1] + 1)[word]
            power = np.cumprod(np.full(max(1, int(place.max()) + 1), 0x100000001B3, np.uint64))
            lexicon = np.add.reduceat(p * power[place], np.append(0, ends[:-1] + 1))
        #: equal words are one kind, and only kinds have features
        _, of_kind, self.kind = np.unique(lexicon, return_index=True, return_inverse=True)
        self.kinds = len(of_kind)
        renumber = np.full(self.n, -1)
        renumber[of_kind] = np.arange(self.kinds)
        w, own = np.arange(self.kinds), renumber[word] >= 0
        last, last2 = p[ends][of_kind], before[ends][of_kind]
        letter_of = renumber[word[own]]
        features = [
            (letter_of, _hash(1, p[own])), (letter_of, _hash(2, before[own], p[own])), (letter_of, _hash(3, before2[own], before[own], p[own])),
            (w, _hash(4, last)), (w, _hash(5, last2, last)), (w, _hash(7, lexicon[of_kind])), (w, _hash(8, before2[ends][of_kind], last2, last)),
        ]
        row, column = np.concatenate([f[0] for f in features]), np.concatenate([f[1] for f in features])
        order = np.argsort(row, kind="stable")
        self.row, self.feature = row[order], column[order]
        self.scale = (1 / np.sqrt(np.maximum(1, np.bincount(self.row, minlength=self.kinds)))).astype(np.float32)
        self.begin = np.searchsorted(self.row, np.arange(self.kinds))
        self.at, self.end = np.flatnonzero(start), inside[ends] + 1
        self.first_of_text = offsets

    def emissions(self, weights: np.ndarray, scripts: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros((0, weights.shape[1]), np.float32)
        out = np.empty((self.kinds, weights.shape[1]), np.float32)
        for a in range(0, self.kinds, 1 << 14):
            z = min(self.kinds, a + (1 << 14))
            lo, hi = self.begin[a], self.begin[z] if z < self.kinds else len(self.row)
            out[a:z] = np.add.reduceat(weights[self.feature[lo:hi]], self.begin[a:z] - lo, axis=0)
        return (out * self.scale[:, None])[self.kind] + scripts[self.scripts]


def _shares(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(axis=1, keepdims=True), 1e-30)


def forward_backward(emission: np.ndarray, line: np.ndarray, start: np.ndarray, transition: np.ndarray, pairs: bool = False):
    """Marginals of each word of lines, in order; with `pairs` also the expected transitions and starts.

    Lines go side by side, longest first; each step is scaled, so lines of any length stay in range.
    """
    n, k = emission.shape
    marginal, expected, starts = np.zeros((n, k)), np.zeros((k, k)), np.zeros(k)
    if not n:
        return marginal, expected, starts
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    length = np.diff(np.append(first, n))
    order = np.argsort(-length, kind="stable")
    weight = np.exp(emission - emission.max(axis=1, keepdims=True)).astype(np.float64)
    step, begin = np.exp(transition.astype(np.float64)), np.exp(start.astype(np.float64))
    for a in range(0, len(order), 4096):
        rows = order[a : a + 4096]
        longest = length[rows[0]]
        alive = np.searchsorted(-length[rows], -np.arange(longest), side="left")  # lines longer than t: a prefix
        at = [first[rows[: alive[t]]] + t for t in range(longest)]
        alpha = [_shares(begin * weight[at[0]])]
        for t in range(1, longest):
            alpha.append(_shares(alpha[-1][: alive[t]] @ step * weight[at[t]]))
        beta = np.ones((alive[longest - 1], k))
        marginal[at[longest - 1]] = alpha[-1]
        for t in range(longest - 1, 0, -1):
            m = alive[t]
            after = weight[at[t]] * beta
            if pairs:
                joint = alpha[t - 1][:m]
                expected += step * ((joint / np.maximum((joint @ step * after).sum(axis=1, keepdims=True), 1e-30)).T @ after)
            grown = np.ones((alive[t - 1], k))
            grown[:m] = _shares(after @ step.T)
            beta = grown
            marginal[at[t - 1]] = _shares(alpha[t - 1] * beta)
        if pairs:
            starts += marginal[at[0]].sum(axis=0)
    return marginal, expected, starts


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    #: what the set of scripts in a word says, beside its letters
    scripts: np.ndarray
    start: np.ndarray
    transition: np.ndarray

    def words(self, words: Words) -> np.ndarray:
        """The distribution of each word."""
        return forward_backward(words.emissions(self.weights, self.scripts), words.line, self.start, self.transition)[0]

    def parts(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last word, language and confidence of each run of words of one language within a line."""
        marginal = self.words(words)
        if not words.n:
            return (*[np.zeros(0, np.int64)] * 3, np.zeros(0))
        best = marginal.argmax(axis=1)
        first = np.flatnonzero(np.append(True, (words.line[1:] != words.line[:-1]) | (best[1:] != best[:-1])))
        last = np.append(first[1:], words.n) - 1
        sure = np.add.reduceat(marginal[np.arange(words.n), best] * words.letters, first) / np.maximum(np.add.reduceat(words.letters, first), 1)
        return first, last, best[first], sure

    def lines(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, confidence and letters of each line; language -1 for lines without letters."""
        marginal = self.words(words)
        weight = words.letters * np.where(words.bracketed, BRACKETED, 1.0)
        mass = np.stack([np.bincount(words.line, weights=weight * marginal[:, k], minlength=words.n_lines) for k in range(len(self.languages))], axis=1)
        letters = np.bincount(words.line, weights=words.letters, minlength=words.n_lines)
        best = mass.argmax(axis=1) if len(mass) else np.zeros(0, np.int64)
        confidence = mass.max(axis=1) / np.maximum(mass.sum(axis=1), 1e-9) if len(mass) else np.zeros(0)
        return np.where(letters > 0, best, -1), confidence, letters


def _fit(words: Words, label: np.ndarray, model: Model, rounds: int, use: np.ndarray, rate: float = 0.1, decay: float = 1e-3) -> None:
    """Adam on the whole sample's log-likelihood; `label` is each line's language, `use` the lines that count."""
    k = len(model.languages)
    keep = use[words.line]
    if not keep.any():
        return
    line, gold = words.line[keep], label[words.line[keep]]
    # kinds of the kept words, their features sorted for the gradient
    kinds, kind = np.unique(words.kind[keep], return_inverse=True)
    renumber = np.full(words.kinds, -1)
    renumber[kinds] = np.arange(len(kinds))
    mask = renumber[words.row] >= 0
    row, feature = renumber[words.row[mask]], words.feature[mask]
    scale, scripts = words.scale[kinds], words.scripts[keep]
    by_feature = np.argsort(feature, kind="stable")
    used, cut = np.unique(feature[by_feature], return_index=True)
    begin = np.searchsorted(row, np.arange(len(kinds)))
    by_kind, kind_cut = np.argsort(kind, kind="stable"), np.searchsorted(np.sort(kind), np.arange(len(kinds)))
    # sequences: lines, some of them joined to the one before, which is in another language
    begins = np.append(True, line[1:] != line[:-1])
    at = np.flatnonzero(begins)
    other = np.append(False, gold[at[1:]] != gold[at[:-1]])
    at = at[~(other & (_hash(9, line[at]) % JOINED == 0))]
    first = np.zeros(len(line), bool)
    first[at] = True
    line = np.cumsum(first)
    gold_next = np.zeros((k, k))
    np.add.at(gold_next, (gold[:-1][~first[1:]], gold[1:][~first[1:]]), 1)
    gold_start = np.bincount(gold[first], minlength=k)
    onehot = np.eye(k, dtype=np.float32)[gold]
    state = {name: [np.zeros_like(x), np.zeros_like(x)] for name, x in (("w", model.weights[used]), ("x", model.scripts), ("s", model.start), ("t", model.transition))}
    n = len(line)
    size = np.bincount(gold, minlength=k)
    balance = np.clip(np.sqrt(size[size > 0].mean() / np.maximum(size, 1)), 0.5, 4).astype(np.float32)  # rare languages are learned as well
    worth, words_of = balance[gold][:, None], np.flatnonzero(keep)[by_kind[kind_cut]]
    for step in range(1, rounds + 1):
        emission = (np.add.reduceat(model.weights[feature], begin, axis=0) * scale[:, None])[kind] + model.scripts[scripts]
        marginal, expected, starts = forward_backward(emission, line, model.start, model.transition, pairs=True)
        miss = np.add.reduceat(((onehot - marginal.astype(np.float32)) * worth)[by_kind], kind_cut, axis=0)
        by_scripts = np.zeros_like(model.scripts)
        np.add.at(by_scripts, words.scripts[words_of], miss)
        miss *= scale[:, None]
        gradient = {"w": np.add.reduceat(miss[row[by_feature]], cut, axis=0) / n - decay / 50 * model.weights[used], "x": by_scripts / n - decay / 50 * model.scripts, "s": (gold_start - starts) / n - decay * model.start, "t": (gold_next - expected) / n - decay * model.transition}
        for name, g in gradient.items():
            m, v = state[name]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            move = (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            if name == "w":
                model.weights[used] += move
            elif name == "x":
                model.scripts += move
            elif name == "s":
                model.start += move
            else:
                model.transition += move


def _empty(names: list[str]) -> Model:
    k = len(names)
    return Model(names, np.zeros((FEATURES, k), np.float32), np.zeros((64, k), np.float32), np.zeros(k, np.float32), np.zeros((k, k), np.float32))


class Sample:
    """Labelled texts, in an order in which languages alternate, so that neighbouring lines are in different ones."""

    def __init__(self, texts: list[str], languages: list[str], to: np.ndarray):
        order = np.argsort([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts], kind="stable")
        self.names = sorted(set(languages))
        self.words = Words([texts[i] for i in order], to)
        self.given = np.array([self.names.index(languages[i]) for i in order], np.int64)
        self.label = self.given[self.words.line_text]

    def fold(self, folds: int) -> np.ndarray:
        return (self.words.text_key % folds)[self.words.line_text]

    def judge(self, fold: int, folds: int, rounds: int, trusted: np.ndarray) -> np.ndarray:
        """The lines of a fold whose label a model of the other folds' trusted lines agrees with."""
        model, mine = _empty(self.names), self.fold(folds) == fold
        _fit(self.words, self.label, model, rounds, ~mine & trusted)
        found, _, letters = model.lines(self.words)
        mass = np.zeros((len(self.given), len(self.names)))
        np.add.at(mass, (self.words.line_text[found >= 0], found[found >= 0]), letters[found >= 0])
        return mine & (found == self.label) & (mass.argmax(axis=1) == self.given)[self.words.line_text]

    def trust(self, agreed: np.ndarray, trusted: np.ndarray, again: bool, few_lines: int) -> np.ndarray:
        """The lines that are trusted from now on.

        Labels of a rare language are mostly wrong ones at first; later, one that loses half of what
        was trusted, or has few lines left, is not judged by the others once more.
        """
        count = lambda m: np.bincount(self.label[m], minlength=len(self.names))
        judged = (count(agreed) * 2 >= count(trusted)) & (count(trusted) >= few_lines) if again else np.full(len(self.names), agreed.any())
        return np.where(judged[self.label], agreed, trusted)


def _in_tasks(spark, jobs: list[int], work) -> dict[int, bytes]:
    """work(job) of each job, all at once, in a task of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in batch["job"].to_pylist():
                yield pa.RecordBatch.from_pydict({"job": pa.array([job], pa.int32()), "result": pa.array([work(job)], pa.binary())})

    rows = spark.range(0, len(jobs), 1, len(jobs)).selectExpr("cast(id as int) as job")
    return {r["job"]: bytes(r["result"]) for r in rows.mapInArrow(run, "job int, result binary").collect()}


def train(spark, texts: list[str], languages: list[str], to: np.ndarray, bounds: SampleBounds) -> Model:
    """Fits a model on texts and their languages, some of them wrong.

    Each fold of the texts is labelled by a model of the others, which cannot know its wrong
    labels by heart. The last fit leaves out texts and lines that were labelled otherwise. What goes
    to the tasks is the sample, what comes back a model: both of a bounded size.
    """
    names = sorted(set(languages))
    if not names:
        return _empty(names)
    sample = Sample(texts, languages, to)
    shared, trusted = spark.sparkContext.broadcast((sample, bounds)), np.ones(sample.words.n_lines, bool)
    for again in (False, True):  # the second time, the judges have learned from trusted lines only
        before = spark.sparkContext.broadcast(trusted)

        def judge(fold: int, before=before) -> bytes:
            sample, bounds = shared.value
            return sample.judge(fold, bounds.folds, bounds.rounds[0], before.value).tobytes()

        parts = _in_tasks(spark, list(range(bounds.folds)), judge)
        agreed = np.logical_or.reduce([np.frombuffer(p, bool) for p in parts.values()])
        trusted = sample.trust(agreed, trusted, again, bounds.few_lines)
    last = spark.sparkContext.broadcast(trusted)

    def fit_all(_: int) -> bytes:
        (sample, bounds), model = shared.value, _empty(names)
        _fit(sample.words, sample.label, model, bounds.rounds[1], last.value)
        return pickle.dumps(model)

    return pickle.loads(_in_tasks(spark, [0], fit_all)[0])


def language_labels(names: DataFrame) -> DataFrame:
    """(label, named): the language of each known spelling, case and outer blanks aside."""
    return names.select(F.lower(F.trim("language_label")).alias("label"), F.col("language").alias("named")).dropDuplicates(["label"])


def _label(c: str):
    return F.lower(F.regexp_replace(F.col(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def fit(docs: DataFrame, key: str, text: str, label: str, names: DataFrame, bounds: SampleBounds = SampleBounds()) -> Model:
    """A model from labelled documents: of each language a fixed number, the same ones in every run."""
    known = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), _label(label).alias("label"))
    known = known.where((F.length("text") > 0) & (F.length("text") <= bounds.characters)).join(F.broadcast(language_labels(names)), "label")
    # ids are chosen first, and a fixed number of them fetches its texts
    order = W.partitionBy("named").orderBy("order", "id")
    chosen = known.select("named", "id", F.xxhash64("id").alias("order")).distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= bounds.documents_per_language)
    sample = known.join(F.broadcast(chosen.select("id", "named")), ["id", "named"]).select("named", "id", "text")
    rows = sample.distinct().toPandas().sort_values(["named", "id", "text"]).drop_duplicates(["named", "id"])
    return train(docs.sparkSession, rows["text"].tolist(), rows["named"].tolist(), _line_table(docs.sparkSession), bounds)


def _line_table(spark) -> np.ndarray:
    to = text_table(spark)
    to[[0x2028, 0x2029]] = 0x20  # only U+000A ends a line
    return to


def document_languages(docs: DataFrame, key: str, text: str, label: str, names: DataFrame, bounds: SampleBounds = SampleBounds()) -> DataFrame:
    """Languages of documents and of the lines of mixed ones.

    Rows (id, segment_no, language, confidence, label, mixed): segment_no 0 is the document, k its
    line k, blank lines counted; lines come only for documents in two or more languages, and only
    those with letters. A document that is delivered again counts once; of several texts of one id,
    the one with the least hash counts, and of several labels the first. Documents with a null
    text or without letters are left out. Ties go to the first language by name. `label` is the
    language that the row's label names, null if it names none. `names`
    (language_label, language) is a fixed table of spellings. Without any labelled document no
    language can be told and the result is empty. Extra columns are not read.
    """
    require_columns(docs, key, text, label)
    require_columns(names, "language_label", "language")
    spark = docs.sparkSession
    model = fit(docs, key, text, label, names, bounds)
    out = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("label_text", T.StringType()), T.StructField("segment_no", T.IntegerType()), T.StructField("language", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("mixed", T.BooleanType()), T.StructField("text_hash", T.LongType())])
    if not model.languages:
        return spark.createDataFrame([], out).select("id", "segment_no", "language", "confidence", F.lit(None).cast("string").alias("label"), "mixed")
    shared = spark.sparkContext.broadcast((model, _line_table(spark)))
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), _label(label).alias("label_text"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash")).where(F.length("text") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, to = shared.value
        k = len(model.languages)
        for batch in cp.slices(batches):
            words = Words(batch["text"].to_pylist(), to)
            language, confidence, letters = model.lines(words)
            has = language >= 0
            cell = words.line_text[has] * k + language[has]
            mass = np.bincount(cell, weights=letters[has], minlength=words.n_texts * k).reshape(-1, k)
            sure = np.bincount(cell, weights=(letters * confidence)[has], minlength=words.n_texts * k).reshape(-1, k)
            doc = np.flatnonzero(mass.sum(axis=1) > 0)
            best = mass.argmax(axis=1)
            mixed = (mass > 0).sum(axis=1) > 1
            in_mixed = np.flatnonzero(has & mixed[words.line_text])
            at = np.concatenate([doc, words.line_text[in_mixed]])
            named = np.concatenate([best[doc], language[in_mixed]])
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([
                batch["id"].take(take), batch["label_text"].take(take),
                pa.array(np.concatenate([np.zeros(len(doc)), words.line_no[in_mixed]]).astype(np.int32)),
                pa.array(np.array(model.languages, object)[named], pa.string()),
                pa.array(np.concatenate([sure[doc, best[doc]] / mass[doc].sum(axis=1), confidence[in_mixed]])),
                pa.array(mixed[at]), batch["text_hash"].take(take),
            ], names=out.names)

    return _with_label(_one_delivery(rows.mapInArrow(run, out), "segment_no"), names)


def _one_delivery(found: DataFrame, *part: str) -> DataFrame:
    """The rows of one delivery of each id, each once; one shuffle, by id."""
    first = W.partitionBy("id").orderBy(F.col("text_hash"), F.col("label_text").asc_nulls_last())
    return found.withColumn("_d", F.dense_rank().over(first)).where("_d = 1").dropDuplicates(["id", *part]).drop("_d")


def line_parts(docs: DataFrame, key: str, text: str, label: str, names: DataFrame, bounds: SampleBounds = SampleBounds()) -> DataFrame:
    """Languages within lines: (id, segment_no, part_no, from_char, to_char, language, confidence).

    Rows come for each run of words of one language, in lines of two or more languages; from_char and
    to_char are places in the consistent form of the text, which has as many lines as the text. What
    is left out and what counts once is as in document_languages().
    """
    require_columns(docs, key, text, label)
    spark = docs.sparkSession
    model = fit(docs, key, text, label, names, bounds)
    out = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("label_text", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("segment_no", "part_no", "from_char", "to_char")), T.StructField("language", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("text_hash", T.LongType())])
    if not model.languages:
        return spark.createDataFrame([], out).drop("label_text", "text_hash")
    shared = spark.sparkContext.broadcast((model, _line_table(spark)))
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), _label(label).alias("label_text"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash")).where(F.length("text") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, to = shared.value
        for batch in cp.slices(batches):
            words = Words(batch["text"].to_pylist(), to)
            first, last, language, sure = model.parts(words)
            line = words.line[first]
            several = np.bincount(line, minlength=words.n_lines)[line] > 1 if len(line) else np.zeros(0, bool)
            number = np.arange(len(line)) - np.searchsorted(line, line) + 1
            owner = words.line_text[line[several]]
            take, base = pa.array(owner), words.first_of_text[owner]
            yield pa.RecordBatch.from_arrays([
                batch["id"].take(take), batch["label_text"].take(take), pa.array(words.line_no[line[several]].astype(np.int32)), pa.array(number[several].astype(np.int32)),
                pa.array((words.at[first[several]] - base).astype(np.int32)), pa.array((words.end[last[several]] - base).astype(np.int32)),
                pa.array(np.array(model.languages, object)[language[several]], pa.string()), pa.array(sure[several]), batch["text_hash"].take(take),
            ], names=out.names)

    return _one_delivery(rows.mapInArrow(run, out), "segment_no", "part_no").drop("label_text", "text_hash")


def _with_label(found: DataFrame, names: DataFrame) -> DataFrame:
    known = language_labels(names).select(F.col("label").alias("label_text"), F.col("named").alias("label"))
    return found.join(F.broadcast(known), "label_text", "left").select("id", "segment_no", "language", "confidence", "label", "mixed")


def label_repairs(docs: DataFrame, key: str, text: str, label: str, names: DataFrame, bounds: SampleBounds = SampleBounds()) -> DataFrame:
    """(id, segment_no, language, confidence): documents with a missing or wrong label, and the lines of mixed ones."""
    found = document_languages(docs, key, text, label, names, bounds)
    wrong = (F.col("segment_no") == 0) & ~F.col("label").eqNullSafe(F.col("language"))
    return found.where(wrong | (F.col("segment_no") > 0)).select("id", "segment_no", "language", "confidence")
