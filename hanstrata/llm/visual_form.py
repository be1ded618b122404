"""One consistent form for texts that look the same.

A text is exploded to positioned code points. Two mapping tables are joined to them: compatibility
decomposition and look-alike letters. Marks are put in the order of their combining class, code
points are composed again, and the text is rebuilt. The tables come from Unicode's data (of
Python's unicodedata and of the ICU library that Spark ships), never grow with the input, and
are broadcast; the join is a gather over the columns of an Arrow batch, so code points never
leave the task and nothing is shuffled to bring a text together again.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hanstrata.functions.inventory import VOWEL_LOOKALIKES
from hanstrata.llm import codepoints as cp
from hanstrata.runtime import checkpoint, require_columns

# Scripts whose letters are taken for Latin ones, in order of preference of the target.
SCRIPT_NAMES = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "HEBREW", "CHEROKEE", "COPTIC", "LISU", "CANADIAN")
#: Keys of a block of a class, and the classes that may hold so much of all rows that they are salted.
BLOCK, HOT_CLASSES, SALTS = 256, 1000, 64
_COMPATIBILITY_VOWELS = range(0x314F, 0x3164)


@cache
def decomposition() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compatibility decomposition: number of code points for each code point, where they start, and all of them."""
    count, flat = np.ones(cp.N, np.int64), []
    start = np.zeros(cp.N, np.int64)
    for c in range(cp.N):
        if 0xAC00 <= c <= 0xD7A3 or 0x4E00 <= c <= 0x9FFF or 0xD800 <= c <= 0xF8FF or c > 0x2FA1F:
            continue  # no mapping, or that of the syllables, which composes back to itself
        to = unicodedata.normalize("NFKD", chr(c))
        if to != chr(c):
            count[c], start[c] = len(to), len(flat)
            flat += map(ord, to)
    return count, start, np.array(flat, np.uint32)


@cache
def combining() -> np.ndarray:
    return np.fromiter((unicodedata.combining(chr(c)) for c in range(cp.N)), np.uint8, cp.N)


@cache
def invisible() -> np.ndarray:
    """Code points with no visible form: format and control characters but the line feed, fillers, variation selectors."""
    out = np.array([unicodedata.category(chr(c)) in ("Cf", "Cc", "Cs") for c in range(cp.N)])
    out[ord("\n")] = False
    for first, last in ((0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF)):
        out[first : last + 1] = True
    out[0x09] = False
    return out


def _script(c: int) -> str:
    name = unicodedata.name(chr(c), "")
    return next((s for s in SCRIPT_NAMES if name.startswith(s)), "")


def lookalike_letters(spark: SparkSession) -> dict[int, int]:
    """Letters that look like a letter of another script, by the ICU library's skeletons.

    A letter is mapped if its skeleton is one letter of another script; the target has the same
    case, so that case still tells texts apart. Hangul and marked letters are never mapped, and
    kana and ideographs stay as they are: both belong to ordinary Japanese.
    """
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    letters = [c for c in range(0x41, 0x10000) if cp.is_letter()[c] and _script(c) and not unicodedata.decomposition(chr(c))]
    # one call for all: skeletons of single letters, set apart by a character that stays itself
    skeletons = checker.getSkeleton(0, "\n".join(map(chr, letters))).split("\n")
    by_skeleton: dict[str, list[int]] = {}
    for c, s in zip(letters, skeletons, strict=True):
        by_skeleton.setdefault(s, []).append(c)
    out = {}
    for s, same in by_skeleton.items():
        for kind in {unicodedata.category(chr(c)) for c in same}:
            alike = [c for c in same if unicodedata.category(chr(c)) == kind]
            best = min(alike, key=lambda c: (SCRIPT_NAMES.index(_script(c)), c != ord(s[0]), c))
            out |= {c: best for c in alike if _script(c) != _script(best)}
            if len(s) == 1 and len(alike) == 1 and _script(ord(s)) == "LATIN" and _script(alike[0]) not in ("LATIN", "") and unicodedata.category(s) == kind:
                out[alike[0]] = ord(s)
    return out


def text_table(spark: SparkSession) -> np.ndarray:
    """What each decomposed code point becomes in texts; 0 for nothing."""
    to = np.arange(cp.N, dtype=np.uint32)
    for c, best in lookalike_letters(spark).items():
        to[c] = best
    to[np.array([unicodedata.category(chr(c)) == "Zs" for c in range(cp.N)])] = 0x20
    to[0x09] = 0x20
    to[invisible()] = 0
    to[[0x2028, 0x2029]] = 0x0A
    return to


def vowel_table() -> np.ndarray:
    """What each decomposed code point becomes in vowel sequences; 0 for nothing. Spaces have no place there."""
    to = np.arange(cp.N, dtype=np.uint32)
    for letter, alike in VOWEL_LOOKALIKES.items():
        to[[ord(c) for c in alike]] = ord(letter)
    for c in _COMPATIBILITY_VOWELS:
        to[ord(unicodedata.normalize("NFKC", chr(c)))] = c
    to[0x119E], to[0x11A1] = 0x318D, 0x318E
    to[np.array([unicodedata.category(chr(c)) in ("Zs", "Cc", "Zl", "Zp") for c in range(cp.N)])] = 0
    to[invisible()] = 0
    return to


def _ordered(points: np.ndarray) -> np.ndarray:
    """Marks in the order of their combining class, from one base character to the next."""
    ccc = combining()[points]
    if not ccc.any():
        return points
    run = np.cumsum(ccc == 0)
    near = np.flatnonzero((ccc > 0) & (np.append(ccc[1:], 0) > 0) & (ccc > np.append(ccc[1:], 0)))
    if not len(near):
        return points
    return points[np.lexsort((np.arange(len(points)), ccc, run))]


def canonical(texts: list[str], to: np.ndarray, compose: bool = True) -> list[str]:
    """The consistent forms of texts."""
    points, offsets = cp.explode(texts)
    count, start, flat = decomposition()
    n = count[points]
    if (n != 1).any() or (start[points] > 0).any():  # join the decompositions
        offsets = np.append(0, np.cumsum(n))[offsets]
        source = np.repeat(points, n)
        within = np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n)
        mapped = (count[source] > 1) | (start[source] > 0) | (source == _FIRST_MAPPED())
        points = np.where(mapped, flat[np.where(mapped, start[source] + within, 0)], source)
    points = to[points]
    points, offsets = cp.keep(points, offsets, points != 0)
    # a mark never crosses from one text to the next: texts are ordered with a base between them
    out = cp.rebuild(_ordered(points), offsets) if not combining()[points[offsets[:-1][offsets[:-1] < len(points)]]].any() else [cp.rebuild(_ordered(points[a:b]), np.array([0, b - a]))[0] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return [unicodedata.normalize("NFC", t) for t in out] if compose else out


@cache
def _FIRST_MAPPED() -> int:  # noqa: N802
    """The code point whose decomposition starts at 0 of the flat table."""
    count, start, flat = decomposition()
    return next(c for c in range(cp.N) if unicodedata.normalize("NFKD", chr(c)) != chr(c))


def with_form(df: DataFrame, column: str, form: str, to: np.ndarray, compose: bool = True) -> DataFrame:
    """df with a column `form`: the consistent form of the string column `column`.

    `to` is text_table(spark) or vowel_table(). Null stays null, the empty text stays empty, a
    text with nothing visible becomes blank. Equal texts of a batch are worked on once. All other
    columns are passed on; a column named like `form` is replaced.
    """
    require_columns(df, column)
    table = df.sparkSession.sparkContext.broadcast(to)
    rest = df.drop(form)
    schema = T.StructType([*rest.schema.fields, T.StructField(form, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cp.slices(batches, column):
            encoded = batch[column].cast(pa.string()).dictionary_encode()
            forms = pa.array(canonical(encoded.dictionary.to_pylist(), table.value, compose), pa.string())
            form_of = forms.take(encoded.indices) if len(forms) else pa.nulls(batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, form_of], names=[*batch.schema.names, form])

    return rest.mapInArrow(run, schema)


def visual_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(class_id, key, text_hash) of each key: texts that look the same have one class_id.

    A key delivered again with the same text counts once. Null texts and texts with nothing
    visible are in no class. Texts themselves are not shuffled, only hashes of 128 and 64 bits;
    a class with a third of all rows is spread by key.
    """
    require_columns(df, key, text)
    formed = with_form(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "text", "form", text_table(df.sparkSession))
    seen = formed.where(F.col("form").isNotNull() & F.col("form").rlike(r"[^\s]"))
    return seen.select(F.md5(F.col("form")).alias("class_id"), "key", F.xxhash64("text").alias("text_hash")).distinct()


def lookalike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key_a, key_b) of different keys, key_a first by code point, whose different texts look the same.

    All such pairs, as the query asks for them; visual_classes says the same in one row for each key.
    A class whose keys all have the same text gives no pair and leaves before the join. Of a class
    the members are put in blocks of about BLOCK keys, and pairs are made of two blocks at a time, so
    that no task holds more than two blocks of a class; classes with at least 1 / HOT_CLASSES of all
    rows, of which there are HOT_CLASSES at most, are salted until their blocks are known.
    """
    members = checkpoint(visual_classes(df, key, text))  # counted, sized and paired
    classes = members.groupBy("class_id").agg(F.count("*").alias("n"), F.min("text_hash").alias("a"), F.max("text_hash").alias("b"))
    hot_from = max(BLOCK, -(-members.count() // HOT_CLASSES))
    salted = F.explode(F.when(F.col("n") >= hot_from, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    mixed = classes.where("a <> b").select("class_id", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), salted.alias("salt"))
    hot = classes.where(F.col("n") >= hot_from).select("class_id", F.lit(True).alias("hot"))
    place = F.xxhash64("key")
    salt = F.when(F.col("hot"), F.pmod(place, F.lit(SALTS)).cast("int")).otherwise(0)
    left = members.join(F.broadcast(hot), "class_id", "left").withColumn("salt", salt).join(mixed, ["class_id", "salt"])
    left = left.select("class_id", "key", "text_hash", "blocks", F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int").alias("own"))
    a = left.select("class_id", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), F.col("key").alias("x"), F.col("text_hash").alias("hash_x"))
    b = left.select("class_id", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), F.col("key").alias("y"), F.col("text_hash").alias("hash_y"))
    pairs = a.join(b, ["class_id", "i", "j"]).where("hash_x <> hash_y and x <> y and (i < j or x < y)")
    return pairs.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def inconsistent_vowels(df: DataFrame, key: str, vowels: str) -> DataFrame:
    """(key, form) of each key whose vowel sequence is not in the consistent form, once; nulls are left out.

    The sequences travel to Python only if they hold anything but vowel letters between single
    commas; the others are consistent by definition.
    """
    require_columns(df, key, vowels)
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vowels}`").alias("vowels"))
    rows = rows.where(F.col("vowels").isNotNull() & ~F.col("vowels").rlike("^[ㅏ-ㅣㆍㆎ](,[ㅏ-ㅣㆍㆎ])*$"))
    formed = with_form(rows, "vowels", "form", vowel_table(), compose=False)
    return formed.where(F.col("form") != F.col("vowels")).select("key", "form").distinct()
