"""Evaluation passages that leak into a corpus.

Retrieval is latent semantic: passages become TF-IDF vectors over letter n-grams, with document
frequencies counted over the whole corpus; a distributed randomised SVD of the passages gives a
latent basis; every document is projected into it and compared with all passages. A document is a
candidate if its score with a passage is at least what any document scores that holds enough of it,
in whatever pieces. Candidates are then verified by a longest common subsequence of long stretches,
so paraphrases by replaced words or characters still count, and the question and answer alone do not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanstrata.llm import codepoints as cp
from hanstrata.llm.visual_form import canonical, text_table
from hanstrata.runtime import require_columns

GRAM = 5
#: Dimensions of the latent space, and those added while the basis is sought.
RANK, OVERSAMPLING, POWER_ITERATIONS = 384, 16, 2
#: Columns of the TF-IDF matrix; the vocabulary's n-grams are hashed to them.
COLUMNS = 1 << 13
#: Passages of a task that works on their matrix.
PASSAGES_PER_TASK = 512
#: Shortest stretch of letters that counts, in alphabets and in syllables or ideographs; letters that a replaced word may have.
MIN_STRETCH = {True: 24, False: 8}
MAX_GAP = {True: 24, False: 8}
#: Shortest run that can be a part of a stretch with replaced words in it.
MIN_RUN = {True: 10, False: 7}
HELD_SHARE = 0.5
#: Scores of a step of the comparison with passages.
_SCORES = 1 << 22
#: Places of a step of the exact check: n-grams of texts in passages, or cells of its tables.
_PLACES = 1 << 21
#: Characters of passages that are searched for in one pass over the corpus: they go to every task.
ITEM_CHARACTERS = 1_000_000
_FILTER_BITS = 22


def letters(texts: list[str], to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of the texts' consistent forms, as code points and offsets."""
    points, offsets = cp.explode([t.lower() for t in canonical(texts, to)])
    return cp.keep(points, offsets, cp.is_letter()[points])


def grams(points: np.ndarray, offsets: np.ndarray, n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams within texts, and the positions where they start."""
    if len(points) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(len(points) - n + 1, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[k : len(points) - n + 1 + k].astype(np.uint64) + np.uint64(1)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    inside = np.ones(len(points), bool)
    for k in range(1, n):
        ends = offsets[1:] - k
        inside[ends[ends >= 0]] = False
    inside = inside[: len(h)]
    at = np.flatnonzero(inside)
    return h[at], at


class Vocabulary:
    """The n-grams of the passages, and a quick filter before the search among them."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - _FILTER_BITS)] = True
        self.column = (self.hashes % np.uint64(COLUMNS)).astype(np.int64)

    def find(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the n-grams that are in the vocabulary, and their positions."""
        maybe = np.flatnonzero(self.filter[hashes >> np.uint64(64 - _FILTER_BITS)])
        h = hashes[maybe]
        index = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        good = self.hashes[index] == h if len(self.hashes) else np.zeros(len(h), bool)
        return index[good], at[maybe[good]]


def _texts(batch: pa.RecordBatch) -> list[str]:
    return batch["text"].to_pylist()


def document_frequencies(docs: DataFrame, vocabulary, to) -> tuple[np.ndarray, int]:
    """Documents that hold each n-gram of the vocabulary, and all documents; one row of counts for a task and n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        count, n = np.zeros(len(v.hashes), np.int64), 0
        for batch in cp.slices(batches):
            texts = _texts(batch)
            count += np.bincount(Held(*letters(texts, to.value), v).gram, minlength=len(v.hashes))
            n += len(texts)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"gram": pa.array([*used.tolist(), -1], pa.int32()), "n": pa.array([*count[used].tolist(), n], pa.int64())})

    size = len(vocabulary.value.hashes)
    out = np.zeros(size + 1, np.int64)
    for gram, n in docs.mapInArrow(run, "gram int, n bigint").groupBy("gram").agg(F.sum("n")).collect():  # bounded by the vocabulary
        out[gram] = n
    return out[:-1], int(out[-1])


def tfidf_rows(points: np.ndarray, offsets: np.ndarray, v: Vocabulary, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (row, column, weight) of the TF-IDF matrix of texts."""
    index, at = v.find(*grams(points, offsets))
    row = np.searchsorted(offsets, at, side="right") - 1
    cell, tf = np.unique(row * len(v.hashes) + index, return_counts=True)
    row, gram = np.divmod(cell, max(1, len(v.hashes)))
    return row, v.column[gram], (tf * idf[gram]).astype(np.float32)


def _times(row, column, weight, n_rows: int, right: np.ndarray) -> np.ndarray:
    """The product of a sparse matrix, by rows, and a dense one; in steps that stay in the processor's cache."""
    out = np.zeros((n_rows, right.shape[1]), np.float32)
    for a in range(0, len(row), 1 << 11):
        z = a + (1 << 11)
        r, start = np.unique(row[a:z], return_index=True)
        out[r] += np.add.reduceat(right[column[a:z]] * weight[a:z, None], start)
    return out


def _gram_product(passages: DataFrame, vocabulary, idf, to, basis, shape: tuple[int, int], squared: bool) -> np.ndarray:
    """The sum over all passages of A'(A basis), or of (A basis)'(A basis), added up block by block."""
    rows_per_block = max(1, (1 << 18) // shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, total = vocabulary.value, None
        for batch in cp.slices(batches):
            points, offsets = letters(_texts(batch), to.value)
            row, column, weight = tfidf_rows(points, offsets, v, idf.value)
            y = _times(row, column, weight, batch.num_rows, basis.value)
            if total is None:
                total = np.zeros(shape, np.float32)
            if squared:
                total += y.T @ y
            else:
                by_column = np.argsort(column, kind="stable")
                total += _times(column[by_column], row[by_column], weight[by_column], shape[0], y)
        if total is not None:
            for k in range(0, shape[0], rows_per_block):
                yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "cells": pa.array([total[k : k + rows_per_block].tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells in zip(batch["block"].to_pylist(), batch["cells"].to_pylist(), strict=True):
                part = np.frombuffer(cells, np.float32)
                blocks[block] = blocks[block] + part if block in blocks else part
        for block, cells in blocks.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "cells": pa.array([cells.tobytes()], pa.binary())})

    kind = "block int, cells binary"
    out = np.zeros(shape, np.float32)
    for block, cells in passages.mapInArrow(run, kind).repartition("block").mapInArrow(add, kind).collect():  # of the basis' size
        part = np.frombuffer(cells, np.float32).reshape(-1, shape[1])
        out[block : block + len(part)] = part
    return out


def latent_basis(passages: DataFrame, vocabulary, idf, to, n_passages: int, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """Right singular vectors of the passages' TF-IDF matrix, by a randomised SVD with power iterations."""
    sc = passages.sparkSession.sparkContext
    size = COLUMNS
    width = max(1, min(rank + OVERSAMPLING, n_passages, size))
    basis = np.random.default_rng(seed).standard_normal((size, width)).astype(np.float32)
    for _ in range(1 + POWER_ITERATIONS):
        b = sc.broadcast(basis)
        basis, _ = np.linalg.qr(_gram_product(passages, vocabulary, idf, to, b, (size, width), squared=False))
        b.unpersist()
    b = sc.broadcast(basis)
    core = _gram_product(passages, vocabulary, idf, to, b, (width, width), squared=True)
    values, vectors = np.linalg.eigh(core.astype(np.float64))
    best = np.argsort(-values)[: min(rank, width)]
    return (basis @ vectors[:, best]).astype(np.float32)


class Items:
    """What every task needs of the passages: all of the passages' size, none of the corpus'.

    N-grams outside the vocabulary take no part in a score, so idf_other weighs nothing.
    """

    def __init__(self, ids: np.ndarray, points, offsets, v: Vocabulary, idf: np.ndarray, idf_other: float, basis: np.ndarray):
        self.ids, self.vocabulary = ids, v
        self.basis, self.idf = basis, idf.astype(np.float32)
        row, column, weight = tfidf_rows(points, offsets, v, idf)
        self.latent = _times(row, column, weight, len(ids), basis)
        self.missed = missed(row, column, weight, self.latent)
        self.length = np.diff(offsets).tolist()
        self.latin = [bool((points[a:b] < 0x250).mean() > 0.5) if b > a else False for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        index, at = v.find(*grams(points, offsets))
        cut = np.searchsorted(at, offsets)
        self.lightest = [np.cumsum(np.sort(idf[index[a:b]] ** 2)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        self.index, self.at, self.cut, self.offsets = index, at, cut, offsets
        # cells: passages of each n-gram, and its places in them
        cell = index * len(ids) + np.searchsorted(offsets, at, side="right") - 1
        self.places = at[np.argsort(cell, kind="stable")]
        cell, self.n_places = np.unique(cell, return_counts=True)
        self.first_place = np.cumsum(self.n_places) - self.n_places
        self.gram, self.holder = np.divmod(cell, max(1, len(ids)))
        self.holders_from = np.searchsorted(self.gram, np.arange(len(v.hashes) + 1))
        self.cells = np.argsort(self.holder, kind="stable")  # of each passage, by n-gram
        self.cells_from = np.searchsorted(self.holder[self.cells], np.arange(len(ids) + 1))

    def least(self, min_share: float) -> tuple[np.ndarray, np.ndarray]:
        """For each passage the fewest places of n-grams that a text has in common with it if it holds min_share, and their least score.

        Of runs of MIN_RUN letters with MAX_GAP replaced ones before each, a text has the fewest
        n-grams in common. Their score is least if they are the passage's commonest. Neither depends
        on where in the text the runs are, or on what else is there.
        """
        places, score = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), np.inf)
        for k, (length, latin, lightest) in enumerate(zip(self.length, self.latin, self.lightest, strict=True)):
            if len(lightest):
                places[k] = min(max(1, math.ceil(min_share * length * (MIN_RUN[latin] - GRAM + 1) / (MIN_RUN[latin] + MAX_GAP[latin]))), len(lightest))
                score[k] = lightest[places[k] - 1] * (1 - 1e-3)  # for rounding
        return places, score

    def places_in(self, text: np.ndarray, gram: np.ndarray, n_texts: int) -> np.ndarray:
        """For each text and passage the passage's places whose n-grams the text has; `text` and `gram` have each pair once."""
        start, n = self.holders_from[gram], self.holders_from[gram + 1] - self.holders_from[gram]
        each = spread(start, n)
        return np.bincount(np.repeat(text * len(self.ids), n) + self.holder[each], weights=self.n_places[each], minlength=n_texts * len(self.ids)).reshape(n_texts, -1)

    def most_held(self, text: np.ndarray, those: np.ndarray, holds: np.ndarray) -> np.ndarray:
        """Letters that each text can hold at most of the passage beside it, if it holds the n-grams under its row of the mask.

        These are runs of MIN_RUN letters and the gaps of MAX_GAP between them, wherever the text has them.
        """
        n = self.cut[those + 1] - self.cut[those]
        k = spread(self.cut[those], n)
        held = np.flatnonzero(holds.ravel()[np.repeat(text * holds.shape[1], n) + self.index[k]])
        of, at = np.repeat(np.arange(len(those)), n)[held], self.at[k[held]]
        if not len(at):
            return np.zeros(len(those))
        new = np.append(True, (np.diff(at) != 1) | (np.diff(of) != 0))
        of, start, end = of[new], at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] + GRAM
        latin = np.array(self.latin)[those[of]].astype(int)
        long = end - start >= np.array([MIN_RUN[False], MIN_RUN[True]])[latin]
        of, start, end, gap = of[long], start[long], end[long], np.array([MAX_GAP[False], MAX_GAP[True]])[latin[long]]
        before = np.append(-1, end[:-1])
        bridged = np.append(False, of[1:] == of[:-1])[: len(of)] & (start - before[: len(of)] <= gap)
        return np.bincount(of, weights=end - np.where(bridged, before[: len(of)], start), minlength=len(those))


def missed(row: np.ndarray, column: np.ndarray, weight: np.ndarray, latent: np.ndarray) -> np.ndarray:
    """Length of what the basis doesn't hold of each row of a sparse matrix: of few items' passages nothing."""
    cell, of = np.unique(row * COLUMNS + column, return_inverse=True)
    square = np.bincount(cell // COLUMNS, weights=np.bincount(of, weights=weight) ** 2, minlength=len(latent))
    return np.sqrt(np.maximum(square - (latent.astype(np.float64) ** 2).sum(axis=1), 0)).astype(np.float32)


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n whole numbers from each start on, one start after the other."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def steps(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges whose sizes add up to `most` at most; a larger one comes alone."""
    total, a, done = np.cumsum(sizes), 0, 0
    while a < len(total):
        z = max(a + 1, int(np.searchsorted(total, done + most, side="right")))
        yield a, z
        a, done = z, int(total[z - 1])


class Held:
    """The n-grams of the vocabulary that texts hold: each text with each of its n-grams once, and the places of both."""

    def __init__(self, points: np.ndarray, offsets: np.ndarray, v: Vocabulary):
        index, at = v.find(*grams(points, offsets))
        self.cell = (np.searchsorted(offsets, at, side="right") - 1) * len(v.hashes) + index
        order = np.argsort(self.cell, kind="stable")
        self.cell, self.places = self.cell[order], at[order]
        self.first_place = np.flatnonzero(np.append(True, np.diff(self.cell) != 0)[: len(at)])
        self.n_places = np.diff(np.append(self.first_place, len(at)))
        # how often a letter is repeated from place to place, and which of the repetitions a place is
        new = np.flatnonzero(np.append(True, (np.diff(self.places) != 1) | (np.diff(self.cell) != 0))[: len(at)])
        n = np.diff(np.append(new, len(at)))
        self.repeated, self.repetition = np.repeat(n, n), np.arange(len(at)) - np.repeat(new, n)
        self.cell = self.cell[self.first_place]
        self.text, self.gram = np.divmod(self.cell, max(1, len(v.hashes)))

    def within_reach(self, place: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Where one letter is repeated far beyond the passage's length, only the ends of the repetition; all other places.

        No stretch is longer than the passage, and none reaches from one end to the other.
        """
        size, k = self.repeated[place], self.repetition[place]
        return (size <= 2 * length + 64) | (k < length) | (size - k <= length)


def candidates(points: np.ndarray, offsets: np.ndarray, items: Items, min_share: float = HELD_SHARE) -> tuple[np.ndarray, Held]:
    """Pairs (text, item) that may score what a text scores that holds min_share of the item's passage.

    A text's score adds up the n-grams that it has anywhere, each once. What the basis misses of
    both sides can add no more than the product of its lengths, which counts as score.
    Also what the texts hold.
    """
    n, v = len(offsets) - 1, items.vocabulary
    held = Held(points, offsets, v)
    text, gram = held.text, held.gram
    column, weight = v.column[gram], items.idf[gram]
    latent = _times(text, column, weight, n, items.basis)
    beyond = missed(text, column, weight, latent)
    least = items.least(min_share)[1]
    step, found = max(1, _SCORES // max(1, len(items.ids))), []
    for a in range(0, n, step):
        scores = latent[a : a + step] @ items.latent.T + beyond[a : a + step, None] * items.missed
        found.append(np.argwhere(scores >= least) + [a, 0])
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64), held


def verified(points: np.ndarray, offsets: np.ndarray, items: Items, min_share: float) -> list[tuple[int, int, float]]:
    """(text, item, held share) of the candidates that hold enough."""
    pairs, held = candidates(points, offsets, items, min_share)
    text, item = possible(pairs, held, items, min_share)
    of_text = np.bincount(held.text, weights=held.n_places, minlength=len(offsets)).astype(np.int64)
    n_cells, length = np.diff(items.cells_from), np.array(items.length)
    found = []
    for a, z in steps(of_text[text] + n_cells[item], _PLACES):
        n = n_cells[item[a:z]]
        of, cell = np.repeat(np.arange(a, z), n), items.cells[spread(items.cells_from[item[a:z]], n)]
        wanted = text[of] * len(items.vocabulary.hashes) + items.gram[cell]
        own = np.minimum(np.searchsorted(held.cell, wanted), len(held.cell) - 1)
        both = np.flatnonzero(held.cell[own] == wanted)
        own, n = own[both], held.n_places[own[both]]
        place, of, cell = spread(held.first_place[own], n), np.repeat(of[both], n), np.repeat(cell[both], n)
        near = np.flatnonzero(held.within_reach(place, length[item[of]]))
        near = near[np.argsort(of[near] * len(points) + held.places[place[near]])]
        cell = cell[near]
        i, j, n = common_runs(held.places[place[near]], items.first_place[cell], items.n_places[cell], items.places, len(points))
        found += held_shares(np.searchsorted(offsets, i, side="right") - 1, i, j, n, items, min_share)
    return found


def possible(pairs: np.ndarray, held: Held, items: Items, min_share: float) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs whose text has n-grams enough, wherever they are, to hold min_share of the passage."""
    fewest, length, size = items.least(min_share)[0], np.array(items.length), len(items.vocabulary.hashes)
    texts = np.unique(pairs[:, 0])
    start, end = np.searchsorted(held.text, texts), np.searchsorted(held.text, texts, side="right")
    holders = np.append(0, np.cumsum(items.holders_from[held.gram + 1] - items.holders_from[held.gram]))
    kept = [np.zeros((0, 2), np.int64)]
    for a, z in steps(holders[end] - holders[start] + size + len(items.ids), _PLACES):
        those = pairs[np.searchsorted(pairs[:, 0], texts[a]) : np.searchsorted(pairs[:, 0], texts[z - 1], side="right")]
        n = end[a:z] - start[a:z]
        of, gram = np.repeat(np.arange(z - a), n), held.gram[spread(start[a:z], n)]
        row = np.searchsorted(texts[a:z], those[:, 0])
        enough = items.places_in(of, gram, z - a)[row, those[:, 1]] >= fewest[those[:, 1]]
        those, row = those[enough], row[enough]
        holds = np.zeros((z - a, size), bool)
        holds[of, gram] = True
        for b, y in steps(items.cut[those[:, 1] + 1] - items.cut[those[:, 1]], _PLACES):
            part = those[b:y]
            kept.append(part[items.most_held(row[b:y], part[:, 1], holds) >= min_share * length[part[:, 1]]])
    text, item = np.concatenate(kept).T
    return text, item


def common_runs(at: np.ndarray, first: np.ndarray, count: np.ndarray, places: np.ndarray, n_points: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unbroken common runs of texts and passages: where each starts in the texts and in the passages, and its letters.

    An n-gram of the texts starts at each of `at`, and in the passages at `count` of `places` from
    `first` on. Places of a run have the same distance. No run reaches from one text or passage to
    the next, as none of their last letters starts an n-gram.
    """
    far = int(places.max(initial=0))
    start, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, z in steps(count, _PLACES):
        i = np.repeat(at[a:z], count[a:z])
        key = np.sort((i - places[spread(first[a:z], count[a:z])] + far) * n_points + i)
        new = np.flatnonzero(np.append(True, np.diff(key) != 1))
        start.append(key[new])
        n.append(np.diff(np.append(new, len(key))))
    start, n = np.concatenate(start), np.concatenate(n)
    order = np.argsort(start)
    start, n = start[order], n[order]
    if len(start):  # runs that go on in the next step
        new = np.flatnonzero(np.append(True, start[1:] != start[:-1] + n[:-1]))
        start, n = start[new], np.add.reduceat(n, new)
    distance, i = np.divmod(start, n_points)
    return i, i - distance + far, n + GRAM - 1


def held_shares(text: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, items: Items, min_share: float) -> list[tuple[int, int, float]]:
    """(text, item, held share) of the pairs whose common runs hold min_share of the passage."""
    item = np.searchsorted(items.offsets, j, side="right") - 1
    latin = np.array(items.latin, bool)[item].astype(int)
    long = n >= np.array([MIN_RUN[False], MIN_RUN[True]])[latin]
    text, item, i, j, n = text[long], item[long], i[long], j[long], n[long]
    if not len(n):
        return []
    order = np.lexsort((j + n, j, item, text))
    text, item, i, j, n = text[order], item[order], i[order], j[order], n[order]
    new = np.append(True, (np.diff(text) != 0) | (np.diff(item) != 0))
    pair, first = np.cumsum(new) - 1, np.flatnonzero(new)
    # no chain holds more than what all runs cover, with the gaps between them that may be bridged
    gap = np.array([MAX_GAP[False], MAX_GAP[True]])[np.array(items.latin, bool)[item].astype(int)]
    span = int(items.offsets[-1]) + 1
    end = np.maximum.accumulate(pair * span + j + n) - pair * span
    before = np.where(new, j, np.append(0, end[:-1]))
    covers = np.where(j + n > before, j + n - np.where(j - before <= gap, before, j), 0)
    enough = np.bincount(pair, weights=covers) >= min_share * np.array(items.length)[item[first]]
    kept = np.flatnonzero(enough[pair])
    kept = kept[np.lexsort((j[kept], i[kept], pair[kept]))]
    first = np.flatnonzero(np.append(True, np.diff(pair[kept]) != 0)[: len(kept)])
    text, item = text[kept[first]], item[kept[first]]
    length = np.array(items.length)[item]
    share = np.minimum(1.0, chained(i[kept], j[kept], n[kept], np.append(first, len(kept)), np.array(items.latin, bool)[item]) / length)
    return [(t, own, s) for t, own, s in zip(text.tolist(), item.tolist(), share.tolist(), strict=True) if s >= min_share]


def chained(i: np.ndarray, j: np.ndarray, n: np.ndarray, first: np.ndarray, latin: np.ndarray) -> np.ndarray:
    """Letters of each pair's passage that lie, in order, in long stretches of its text.

    `i`, `j` and `n` are the common runs, in order within each pair: place in the text, place in the
    passage, letters; those of a pair are from `first` on. A stretch is an unbroken common run, or
    several with single replaced words between them, which then count as held. Stretches are
    chained to their longest common subsequence, a run of all pairs at once.
    """
    order = np.argsort(first[:-1] - first[1:], kind="stable")  # pairs of most runs first
    start, size = first[:-1][order], np.diff(first)[order]
    least, gap = (np.array([of[False], of[True]])[latin[order].astype(int)][:, None] for of in (MIN_STRETCH, MAX_GAP))
    score = np.zeros(len(n), np.int64)  # of the best chain that ends with a run; 0: no stretch of full length in it yet
    for x in range(int(size.max(initial=0))):
        those = int(np.searchsorted(-size, -x))
        own = start[:those, None] + x
        top = np.where(n[own] >= least[:those], n[own], 0)
        if x:
            y = start[:those, None] + np.arange(x)
            before, after = j[own] - j[y] - n[y], i[own] - i[y] - n[y]
            new = n[own] - np.maximum(0, -np.minimum(before, after))
            near = np.where(score[y] > 0, score[y], n[y]) + new + np.maximum(before, 0)
            far = np.where((score[y] > 0) & (new >= least[:those]), score[y] + new, 0)
            s = np.where((before <= gap[:those]) & (after <= gap[:those]), near, far)
            s[(new <= 0) | (j[y] > j[own])] = 0
            top = np.maximum(top, s.max(axis=1, keepdims=True))
        score[own] = np.where(top >= least[:those], top, 0)
    return np.maximum.reduceat(score, first[:-1]) if len(score) else np.zeros(0, np.int64)


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, answer: str | None = None, rank: int = RANK, min_share: float = HELD_SHARE) -> DataFrame:
    """(doc_id, item_id, held_share, answer_found) of each document that holds at least min_share of an item's passage.

    answer_found tells whether the document also holds the letters of the item's `answer`; null
    without the column and for answers without letters. It decides nothing.

    Null and empty texts and passages hold nothing and are held by nothing. A document or item that
    is given twice is reported once. Texts of any length are searched whole. Extra columns are not
    read. Items go to every task, so those with more than ITEM_CHARACTERS characters are searched for
    in blocks of items, each in passes of its own.
    """
    require_columns(docs, doc_id, text)
    require_columns(items, item_id, passage)
    given = items.where(F.length(passage) > 0)
    size = given.agg(F.sum(F.length(passage))).first()[0] or 0
    n = -(-size // ITEM_CHARACTERS) or 1
    block = F.pmod(F.xxhash64(F.col(f"`{item_id}`").cast("string")), F.lit(n))
    parts = [_leaked(docs, doc_id, text, given.where(block == k), item_id, passage, answer, rank, min_share) for k in range(n)]
    return reduce(DataFrame.unionByName, parts)


def _leaked(docs: DataFrame, doc_id: str, text: str, given: DataFrame, item_id: str, passage: str, answer: str | None, rank: int, min_share: float) -> DataFrame:
    """leaked_items for one block of items."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    id_type = given.schema[item_id].dataType
    held = given.select(F.col(f"`{item_id}`").alias("id"), F.col(f"`{passage}`").alias("text"), (F.col(f"`{answer}`") if answer else F.lit(None)).cast("string").alias("answer")).dropDuplicates(["id", "text"])
    local = held.toPandas()
    to = sc.broadcast(text_table(spark))
    points, offsets = letters(local["text"].tolist(), to.value)
    v = sc.broadcast(Vocabulary(grams(points, offsets)[0]))
    out = docs.select(F.col(f"`{doc_id}`").alias("doc_id")).schema.add("item_id", id_type).add("held_share", "double").add("answer_found", "boolean")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where(F.length("text") > 0)
    if not len(v.value.hashes):
        return spark.createDataFrame([], out)
    df, n_docs = document_frequencies(rows.select("text"), v, to)
    idf = np.log((n_docs + 1) / (df + 1)) + 0.1
    basis = latent_basis(held.repartition(-(-len(local) // PASSAGES_PER_TASK)), v, sc.broadcast(idf), to, len(local), rank)
    answer_points, answer_offsets = letters([a if isinstance(a, str) else "" for a in local["answer"]], to.value)
    answers = sc.broadcast(cp.rebuild(answer_points, answer_offsets))
    known = sc.broadcast(Items(local["id"].to_numpy(), points, offsets, v.value, idf, float(np.log(n_docs + 1) + 0.1), basis))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cp.slices(batches):
            p, o = letters(_texts(batch), to.value)
            found = []
            for d, i, share in verified(p, o, known.value, min_share):
                own = answers.value[i]
                found.append((d, known.value.ids[i], share, own in cp.rebuild(p[o[d] : o[d + 1]], np.array([0, o[d + 1] - o[d]]))[0] if own else None))
            ids = batch["doc_id"].take(pa.array([f[0] for f in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([f[1] for f in found]).cast(schema_item) if found else pa.array([], schema_item), pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.bool_())], names=out.names)

    from pyspark.sql.pandas.types import to_arrow_type

    schema_item = to_arrow_type(id_type)
    found = rows.mapInArrow(search, out)
    return found.groupBy("doc_id", "item_id").agg(F.max("held_share").alias("held_share"), F.max("answer_found").alias("answer_found"))
