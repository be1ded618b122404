"""Documents that are template residue, filler, error pages or script notices.

Exemplars of residue are a table of labels and texts. An inverted index leads from their features to
them; every passage window of a document is looked up in it. Windows are sentences and lines, with
n-grams of letters as features, and bracketed spans, whose features are symbols as well. An exemplar
that a window shares features with is retrieved, and the window's TF-IDF containment in the retrieved
exemplars of a label is computed, with document frequencies counted over the whole corpus: n-grams of
ordinary text weigh little, n-grams that no exemplar has count against the window. A document whose
windows are covered, headings and navigation aside, is residue. A placeholder must be contained in
its span whole, in order, so that its containment is 1 whatever its features weigh; a word typed from
the letters of one exemplar is contained in it whole as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hanstrata.llm import codepoints as cp
from hanstrata.llm import residue_exemplars as X
from hanstrata.llm.visual_form import canonical, text_table
from hanstrata.runtime import require_columns

LABELS = ("filler", "error_page", "script_notice", "navigation")
#: Containment from which a window is residue, and the share of residue from which a document is.
WINDOW_COVERAGE = 0.5
DOCUMENT_COVERAGE = 0.5
#: Weight of an n-gram that no exemplar has, as a part of the highest weight that there is.
OTHER_WEIGHT = 0.75
#: Letters that a heading may have: a line without the end of a sentence.
HEADING_LETTERS = 12
#: N-grams that a window shares with an exemplar that is retrieved for it.
SHARED = 2
#: Exemplars that a table may have: they go to every task.
MAX_EXEMPLARS = 50_000
#: A word of so many letters from one alphabet is senseless, if most words of its window are.
SENSELESS_WORD = 3
_SPACE = np.uint32(0x20)
_FILTER_BITS = 22
_TOKEN = re.compile(r"\{\{\{|\}\}\}|\{\{|\}\}|\{%|%\}|<%=|<%|%>|<\?|\?>|\$\{|#\{|%\(|\)[sd](?![a-z])|\[\[|\]\]|%%|@@|\$\$|##|<<|>>|&lt;|&gt;|__+|[\[\]{}()<>]|[^\W_]+(?:_[^\W_]+)*|\S")
_OPENING = re.compile(r"\{\{|\{%|<%|<\?|\$\{|#\{|%\(|\[|%%|@@|\$\$|##|<|&lt;|__|[\{(]")
#: A placeholder may go on in the next line within so many characters and tokens.
_NEAR, _NEAR_TOKENS = 80, 12


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def _keyword_features(token: str) -> list[str]:
    """What a token is found by: a symbol by itself, a word by its pairs of letters, as it may be glued to others."""
    return [token[i : i + 2] for i in range(len(token) - 1)] if token[0].isalnum() and len(token) > 1 else ["__" if token.startswith("__") else token]


class Placeholders:
    """Inverted index of the placeholder exemplars by their symbols and pairs of letters."""

    def __init__(self, exemplars: list[tuple[str, str]]):
        self.parts: list[tuple[str, ...]] = []
        self.short: set[tuple[str, ...]] = set()
        for label, exemplar in exemplars:
            if label in ("placeholder", "short_placeholder"):
                parts = tuple(p if p in ("W", "0") else p.lower() for p in exemplar.split(" "))
                self.parts.append(parts)
                if label == "short_placeholder":
                    self.short.add(parts)
        self.parts.sort(key=len, reverse=True)
        self.features = [frozenset(f for p in parts if p not in ("W", "0") for f in _keyword_features(p)) for parts in self.parts]
        #: the exemplars of each opening symbol, whose other features are then looked for in the span
        self.postings: dict[str, list[int]] = {}
        for k, parts in enumerate(self.parts):
            self.postings.setdefault(parts[0], []).append(k)

    def retrieved(self, span: list[str]) -> list[tuple[str, ...]]:
        """The exemplars whose features a span has, all of them; in order of length."""
        known = self.postings.get("__" if span[0].startswith("__") else span[0])
        if not known:
            return []
        features = {f for token in span for f in _keyword_features(token)}
        return [self.parts[k] for k in known if self.features[k] <= features]

    def contained(self, parts: tuple[str, ...], window: list[str]) -> bool:
        """True if the window holds the whole exemplar, from its start, in order: a containment of 1."""
        most, between = (4, "().'-") if parts in self.short else (len(window), "().'-,:;/·、&\"")

        def at(p: int, w: int) -> bool:
            if p == len(parts):
                return True
            if w >= len(window):
                return False
            part, token = parts[p], window[w]
            if part == "W":
                # a keyword may be glued to the end of a word, as suffixes are in Korean and Japanese
                for n in range(1, most + 1):
                    if w + n > len(window) or not (window[w + n - 1][0].isalnum() or window[w + n - 1] in between):
                        return False
                    if at(p + 1, w + n) or (p + 1 < len(parts) and len(parts[p + 1]) > 1 and parts[p + 1].isalnum() and window[w + n - 1].endswith(parts[p + 1]) and at(p + 2, w + n)):
                        return True
                return False
            if part == "0":
                return token.isdigit() and at(p + 1, w + 1)
            same = token == part or (part == "__" and token.startswith("__")) or (part[0].isalnum() and len(part) > 1 and token.startswith(part) and not token.isascii())
            return same and at(p + 1, w + 1)

        return at(0, 0)

    def find(self, text: str) -> str | None:
        """The first exemplar that the text holds; text is in consistent form."""
        low = text.lower()
        for m in _OPENING.finditer(low):
            window = _tokens(low[m.start() : m.start() + _NEAR])[:_NEAR_TOKENS]
            if not window:
                continue
            known = self.postings.get("__" if window[0].startswith("__") else window[0], ())
            for span in (window, self.span(low, m.start(), {self.parts[k][-1] for k in known})):
                for parts in self.retrieved(span) if span else ():
                    if self.contained(parts, span):
                        return " ".join(parts)
        return None

    @staticmethod
    def span(text: str, start: int, closing: set[str]) -> list[str]:
        """Tokens from an opening to the closing token that belongs to it, in the same line; none if they are near."""
        end = text.find("\n", start)
        end = len(text) if end < 0 else end
        out: list[str] = []
        if not any(text.find(c, start + 1, end) >= 0 for c in closing):
            return out
        depth = 0
        for m in _TOKEN.finditer(text, start, end):
            out.append(m[0])
            depth += len(out) > 1 and m[0] == out[0]
            if len(out) > 1 and m[0] in closing:
                if not depth:
                    return out if m.end() > start + _NEAR or len(out) > _NEAR_TOKENS else []
                depth -= 1
        return []


class Windows:
    """Passage windows of texts: word n-grams, letters and the end of a sentence of each."""

    def __init__(self, texts: list[str], to: np.ndarray):
        # same length in lower case, so that a text's offsets hold
        forms = canonical(texts, to)
        points, offsets = cp.explode([f if len(low := f.lower()) != len(f) else low for f in forms])
        letter, line = cp.is_letter()[points], points == 10
        stop = np.isin(points, _STOPS)
        digit = cp.categories()[points] == ord("N")
        # a Latin word with a digit in it is a number, not a word
        word_char = letter | digit
        run = np.flatnonzero(word_char & ~np.append(False, word_char[:-1]))
        if len(run) and digit.any():
            run_of = np.cumsum(word_char & ~np.append(False, word_char[:-1])) - 1
            numbered = np.zeros(len(run), bool)
            numbered[run_of[digit]] = True
            letter &= ~(word_char & numbered[np.maximum(run_of, 0)] & (points < 0x250))
        starts = np.zeros(len(points) + 1, bool)
        starts[offsets] = True
        after_stop = np.append(False, stop[:-1] & ~stop[1:]) if len(points) else stop
        cut = starts[:-1] | np.append(False, line[:-1]) | after_stop if len(points) else starts[:-1]
        self.window = np.cumsum(cut) - 1
        self.n = int(cut.sum())
        at = np.flatnonzero(cut)
        self.text = np.searchsorted(offsets, at, side="right") - 1
        self.points = np.where(letter, points, _SPACE)
        self.letter = letter
        self.letters = np.bincount(self.window[letter], minlength=self.n)
        ended = np.zeros(self.n, bool)
        ended[self.window[stop]] = True
        self.ended = ended

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of letter n-grams of words, padded by blanks, and the windows they are in."""
        p = self.points
        if not len(p):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.letter)
        same = self.window[1:] == self.window[:-1]
        before = np.where(np.append(False, same), np.append(_SPACE, p[:-1]), _SPACE)
        after = np.where(np.append(same, False), np.append(p[1:], _SPACE), _SPACE)
        # of alphabets, whose letters say little, five letters
        two_before = np.where(np.append(False, same) & (before != _SPACE), np.append(_SPACE, before[:-1]), _SPACE)
        two_after = np.where(np.append(same, False) & (after != _SPACE), np.append(after[1:], _SPACE), _SPACE)
        latin = p[at] < 0x250
        h = (before[at].astype(np.uint64) << np.uint64(42)) ^ (p[at].astype(np.uint64) << np.uint64(21)) ^ after[at]
        far = (two_before[at].astype(np.uint64) << np.uint64(21)) ^ two_after[at]
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(latin, far + np.uint64(1), np.uint64(0)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32)), self.window[at]

    def senseless(self, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of each window's letters in words that one exemplar of letters holds whole, and the first such exemplar.

        `masks` has the exemplars of each letter, as bits.
        """
        start = self.letter & ~np.append(False, self.letter[:-1] & (self.window[1:] == self.window[:-1])) if len(self.points) else self.letter
        at = np.flatnonzero(start)
        if not len(at):
            return np.zeros(self.n), np.zeros(self.n, np.int64)
        inside = np.flatnonzero(self.letter)
        word = (np.cumsum(start) - 1)[inside]
        cut = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        mask, length = np.bitwise_and.reduceat(masks[self.points[inside]], cut), np.diff(np.append(cut, len(inside)))
        bad = np.flatnonzero((mask > 0) & (length >= SENSELESS_WORD))
        which = np.zeros(self.n, np.int64)
        lowest = mask[bad] & (~mask[bad] + np.uint64(1))
        which[self.window[at][bad[::-1]]] = np.log2(lowest[::-1].astype(np.float64)).astype(np.int64)
        return np.bincount(self.window[at][bad], weights=length[bad], minlength=self.n) / np.maximum(self.letters, 1), which


_STOPS = np.array([ord(c) for c in ".。!?！？"], np.uint32)


class Index:
    """From n-grams to the exemplars that have them."""

    def __init__(self, exemplars: list[tuple[str, str]], to: np.ndarray):
        self.alphabets = [text for label, text in exemplars if label == "filler_letters"]
        if len(self.alphabets) > 64:
            raise ValueError("at most 64 exemplars of letters can be told apart")
        self.masks = np.zeros(cp.N, np.uint64)
        for k, letters in enumerate(self.alphabets):
            # letters that follow each other may be composed, as a consonant and a vowel are; each also stands alone
            for form in canonical([*letters, *(a + b for a in letters for b in letters)], to):
                self.masks[[ord(c) for c in form]] |= np.uint64(1 << k)
        mine = [(LABELS.index(label), text) for label, text in exemplars if label in LABELS]
        self.exemplars, label = [text for _, text in mine], np.array([k for k, _ in mine], np.int64)
        w = Windows([re.sub(r"[.。!?！？]", " ", e) for e in self.exemplars], to)
        hashes, window = w.grams()
        self.hashes, self.gram = np.unique(hashes, return_inverse=True)
        self.exemplar = w.text[window]
        self.label = label
        self.member = np.zeros((len(self.hashes), len(LABELS)), bool)
        self.member[self.gram, label[self.exemplar]] = True
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - _FILTER_BITS)] = True
        order = np.lexsort((self.exemplar, self.gram))
        pair = np.unique(np.stack([self.gram[order], self.exemplar[order]]), axis=1)
        self.postings, self.first = pair[1], np.searchsorted(pair[0], np.arange(len(self.hashes) + 1))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the n-grams that exemplars have, and their indices."""
        maybe = np.flatnonzero(self.filter[hashes >> np.uint64(64 - _FILTER_BITS)])
        if not len(self.hashes):
            return maybe, maybe
        index = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        good = self.hashes[index] == hashes[maybe]
        return maybe[good], index[good]


def document_frequencies(docs: DataFrame, index, to) -> tuple[np.ndarray, int]:
    """Documents that hold each n-gram of the exemplars, and all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        count, n = np.zeros(len(x.hashes), np.int64), 0
        for batch in cp.slices(batches):
            w = Windows(batch["text"].to_pylist(), to.value)
            hashes, window = w.grams()
            at, gram = x.find(hashes)
            cell = np.unique(w.text[window[at]].astype(np.int64) * len(x.hashes) + gram)
            count += np.bincount(cell % len(x.hashes), minlength=len(x.hashes))
            n += batch.num_rows
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"gram": pa.array([*used.tolist(), -1], pa.int32()), "n": pa.array([*count[used].tolist(), n], pa.int64())})

    out = np.zeros(len(index.value.hashes) + 1, np.int64)
    for gram, n in docs.mapInArrow(run, "gram int, n bigint").groupBy("gram").agg(F.sum("n")).collect():  # bounded by the exemplars
        out[gram] = n
    return out[:-1], int(out[-1])


def contained(w: Windows, x: Index, window: np.ndarray, at: np.ndarray, gram: np.ndarray, idf: np.ndarray, idf_other: float) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF containment of each window in the exemplars of each label that are retrieved for it, and the best exemplar of each label.

    A window that all exemplars of a label together don't cover enough needs no retrieval: the result
    has their bound there, which is too little.
    """
    weight = idf_other * np.bincount(window, minlength=w.n)
    weight += np.bincount(window[at], weights=idf[gram] - idf_other, minlength=w.n)
    weight = np.maximum(weight, 1e-9)
    coverage = np.stack([np.bincount(window[at], weights=idf[gram] * x.member[gram, k], minlength=w.n) for k in range(len(LABELS))], axis=1) / weight[:, None]
    best = np.full((w.n, len(LABELS)), -1)
    likely = np.flatnonzero(coverage.max(axis=1)[window[at]] >= WINDOW_COVERAGE)
    if not len(likely):
        return coverage, best
    g = gram[likely]
    n = x.first[g + 1] - x.first[g]
    entry = np.repeat(np.arange(len(likely)), n)  # a found n-gram of the window, once for each exemplar that has it
    exemplar = x.postings[np.repeat(x.first[g] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    of = window[at[likely]]
    pair, which = np.unique(of[entry] * len(x.exemplars) + exemplar, return_inverse=True)
    # distinct n-grams that window and exemplar share, and what they weigh
    cell = np.unique(which * np.int64(len(x.hashes)) + g[entry])
    shared = np.bincount(cell // len(x.hashes), minlength=len(pair))
    overlap = np.bincount(cell // len(x.hashes), weights=idf[cell % len(x.hashes)], minlength=len(pair))
    good = shared >= SHARED
    covered = np.zeros((len(likely), len(LABELS)), bool)
    covered[entry[good[which]], x.label[exemplar[good[which]]]] = True
    those = np.unique(of)
    for k in range(len(LABELS)):
        coverage[those, k] = np.bincount(of, weights=idf[g] * covered[:, k], minlength=w.n)[those] / weight[those]
    order = np.argsort(overlap, kind="stable")
    order = order[good[order]]
    best[(pair // len(x.exemplars))[order], x.label[(pair % len(x.exemplars))[order]]] = (pair % len(x.exemplars))[order]
    return coverage, best


def classify(texts: list[str], x: Index, idf: np.ndarray, idf_other: float, to: np.ndarray) -> list[tuple[int, str, float, str]]:
    """(text, label, coverage, exemplar) of the texts that are residue as a whole."""
    w = Windows(texts, to)
    hashes, window = w.grams()
    at, gram = x.find(hashes)
    coverage, best = contained(w, x, window, at, gram, idf, idf_other)
    typed, alphabet = w.senseless(x.masks)
    by_letters = typed > coverage[:, 0]
    coverage[:, 0] = np.maximum(coverage[:, 0], typed)
    label = np.argmax(coverage, axis=1)
    residue = (coverage.max(axis=1) >= WINDOW_COVERAGE) & (w.letters > 0)
    navigation = residue & (label == LABELS.index("navigation"))
    heading = ~residue & ~w.ended & (w.letters <= HEADING_LETTERS)
    counted = ~heading & ~navigation & (w.letters > 0)
    n = len(texts)
    whole = np.bincount(w.text[counted], weights=w.letters[counted], minlength=n)
    bad = residue & ~navigation
    part = np.bincount(w.text[bad], weights=w.letters[bad], minlength=n)
    share = part / np.maximum(whole, 1)
    found = np.flatnonzero((part > 0) & (share >= DOCUMENT_COVERAGE))
    if not len(found):
        return []
    strongest = np.full(n, -1)
    order = np.argsort(np.where(bad, w.letters * coverage.max(axis=1), -1), kind="stable")
    strongest[w.text[order]] = order
    out = []
    for d in found.tolist():
        s = strongest[d]
        exemplar = x.alphabets[alphabet[s]] if label[s] == 0 and by_letters[s] else x.exemplars[best[s, label[s]]]
        out.append((d, LABELS[label[s]], float(share[d]), exemplar))
    return out


def residue_documents(df: DataFrame, doc_id: str, text: str, exemplars: DataFrame | None = None) -> DataFrame:
    """(doc_id, reason, coverage, exemplar) of the documents to be excluded.

    `exemplars` has (label, text), with the labels placeholder, short_placeholder (of four words at
    most), filler, filler_letters, error_page, script_notice and navigation; without it,
    residue_exemplars.table() is used. More than MAX_EXEMPLARS raise ValueError. `reason` is
    placeholder, filler, error_page or script_notice; `exemplar` is the retrieved one that most of the
    document's residue is contained in, and `coverage` the share of the text that is covered. Null,
    empty and letterless texts are not residue, unless they hold a placeholder. A document given twice
    comes out twice. Whole texts are searched, of any length; extra columns are not read. Nothing but
    counts of the exemplars' n-grams is shuffled.
    """
    require_columns(df, doc_id, text)
    sc = df.sparkSession.sparkContext
    if exemplars is None:
        known_exemplars = X.table()
    else:
        require_columns(exemplars, "label", "text")
        given = exemplars.where("label is not null and text <> ''").select("label", "text").distinct()
        known_exemplars = sorted(map(tuple, given.limit(MAX_EXEMPLARS + 1).collect()))
        if len(known_exemplars) > MAX_EXEMPLARS:
            raise ValueError(f"more than {MAX_EXEMPLARS} exemplars are too many to send to every task")
    to = sc.broadcast(text_table(df.sparkSession))
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where(F.length("text") > 0)
    index = sc.broadcast(Index(known_exemplars, to.value))
    count, n_docs = document_frequencies(rows.select("text"), index, to)
    idf, idf_other = np.log((n_docs + 1) / (count + 1)) + 0.1, float(OTHER_WEIGHT * np.log(n_docs + 1) + 0.1)
    known = sc.broadcast((idf, idf_other))
    out = T.StructType([*rows.select("doc_id").schema.fields, T.StructField("reason", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("exemplar", T.StringType())])
    marks = re.compile(r"[{}\[\]<>%@$#_［］＜＞｛｝＿％＠＄＃（(]|&lt;")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placeholders = Placeholders(known_exemplars)
        for batch in cp.slices(batches):
            texts = batch["text"].to_pylist()
            found = {d: rest for d, *rest in classify(texts, index.value, *known.value, to.value)}
            marked = [d for d, t in enumerate(texts) if marks.search(t)]
            for d, form in zip(marked, canonical([texts[d] for d in marked], to.value), strict=True):
                if exemplar := placeholders.find(form):
                    found[d] = ["placeholder", 1.0, exemplar]
            at = sorted(found)
            columns = [pa.array([found[d][k] for d in at], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(at, pa.int64())), *columns], names=out.names)

    return rows.mapInArrow(run, out)
