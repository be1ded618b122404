"""Column functions on texts: normal forms, white space, controls, scripts."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hanstrata.functions.inventory import NOT_COUNTED, SCRIPT_CLASSES

# Fixed value: what str.strip() takes off, in a character class.
WHITE = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no built-in function for it. Null stays null."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@cache
def _script_tables() -> dict[str, np.ndarray]:
    """For each code point, whether it counts for a script class."""
    import regex

    every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, sys.maxunicode + 1)))
    hits = lambda pattern: {m.start() for m in regex.finditer(pattern, every)}
    left_out = hits(r"[\p{P}\p{Z}\s\d\x{119E}\x{318D}]".replace(r"\x{119E}\x{318D}", "\u119e\u318d"))
    out = {}
    for name, pattern in SCRIPT_CLASSES.items():
        own = regex.sub(r"\\x\{(\w+)\}", lambda m: regex.escape(chr(int(m[1], 16))), pattern)
        own = regex.sub(r"\\p\{Is(\w+)\}", r"\\p{Script=\1}", own)
        table = np.zeros(sys.maxunicode + 1, bool)
        table[list(hits(own) - left_out)] = True
        out[name] = table
    return out


_NOT_LINE = r"[^\S\n\x1c-\x1f]"
_AROUND_LINE, _LINES, _BLANKS, _CONTROLS = (re.compile(p) for p in (rf"{_NOT_LINE}*\n{_NOT_LINE}*", r"\n+", rf"{_NOT_LINE}+", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"))


def stored_form(text: str) -> str:
    """What normalize() makes of a text."""
    text = unicodedata.normalize("NFKC", text)
    text = _LINES.sub("\n", _AROUND_LINE.sub("\n", text))
    return _CONTROLS.sub("", _BLANKS.sub(" ", text).strip())


#: A column that stage 01 makes and drops: how many frequent words of each language in Latin letters a text has.
LATIN_WORDS = "latin_words"
# Frequent words that only one of the languages in Latin letters has.
FREQUENT_WORDS = {
    "eng_Latn": ("the", "of", "and", "to", "was", "that", "with", "for", "is", "by", "from", "were", "which", "not", "this", "at", "it", "had", "been", "an"),
    "fra_Latn": ("le", "les", "des", "et", "du", "une", "dans", "est", "qui", "au", "pour", "par", "sur", "il", "ce", "pas", "ont", "avec", "été", "aux"),
    "spa_Latn": ("el", "los", "las", "y", "del", "una", "que", "por", "con", "se", "fue", "al", "su", "más", "como", "pero", "fueron", "sus", "ha", "lo"),
}
_WORD_OF = {w: x for x, words in FREQUENT_WORDS.items() for w in words}
_LATIN_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_WORDS = T.StructType([T.StructField(x, T.IntegerType()) for x in FREQUENT_WORDS])
_PROFILED = T.StructType([T.StructField("text", T.StringType()), *(T.StructField(k, T.DoubleType()) for k in SCRIPT_CLASSES), *_WORDS.fields])


@F.pandas_udf(_PROFILED)
def _profiled(text: pd.Series) -> pd.DataFrame:
    """Stored form of texts, its shares of the script classes and its frequent words, in one pass over the batch."""
    forms = text.map(stored_form, na_action="ignore")
    given = [f if isinstance(f, str) else "" for f in forms]
    points = np.frombuffer("".join(given).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(given)), [len(f) for f in given])
    n = {k: np.bincount(owner[table[points]], minlength=len(given)) for k, table in _script_tables().items()}
    total = n["kor"] + n["jpn"] + n["han"] + n["lat"]
    words = {x: np.zeros(len(given), np.int32) for x in FREQUENT_WORDS}
    for i in np.flatnonzero(n["lat"]):
        for w in _LATIN_WORD.findall(given[i]):
            if x := _WORD_OF.get(w.lower()):
                words[x][i] += 1
    return pd.DataFrame({"text": forms} | {k: np.where(total > 0, c / np.maximum(total, 1), 0.0) for k, c in n.items()} | words)


def with_normal_text(df: DataFrame, text: str = "text", prefix: str = "script_") -> DataFrame:
    """df with texts in their stored form, that of normalize(), the share of each script class, and LATIN_WORDS.

    Form and shares are made in one Arrow pass, as the form needs Python anyway. What filters look
    at later is then a field of that pass; columns of expressions would be copied into each filter.
    """
    # declared so that the planner never evaluates it again for a filter on what follows from it
    df = df.withColumn("_p", _profiled.asNondeterministic()(F.col(text)))
    words = F.struct(*(F.col(f"_p.{x}").alias(x) for x in FREQUENT_WORDS))
    return df.withColumns({text: F.col("_p.text"), LATIN_WORDS: words} | {prefix + k: F.col(f"_p.{k}") for k in SCRIPT_CLASSES}).drop("_p")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WHITE}]+|[{WHITE}]+$", "")


def squeeze_space(c: Column, keep_lines: bool = True) -> Column:
    """White space to single blanks; with keep_lines, line breaks stay, one at a time, with no space around."""
    if not keep_lines:
        return strip(F.regexp_replace(c, r"(?U)\s+", " "))
    c = F.regexp_replace(c, r"(?U)[\s&&[^\n]]*\n[\s&&[^\n]]*", "\n")
    c = F.regexp_replace(c, r"\n+", "\n")
    return strip(F.regexp_replace(c, r"(?U)[\s&&[^\n]]+", " "))


def remove_controls(c: Column) -> Column:
    """Without C0 and C1 controls, but for tab, line feed and carriage return."""
    return F.regexp_replace(c, r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]", "")


def normalize(c: Column) -> Column:
    """The stored form of a text: compatibility composition, squeezed space, no controls, in this order."""
    return remove_controls(squeeze_space(nfkc(c)))


def letters_only(c: Column) -> Column:
    return F.regexp_replace(nfkc(c), r"[^\p{L}]", "")


#: The columns of script shares: kor, oko, jpn, han and lat.
SCRIPTS = tuple(SCRIPT_CLASSES)


def with_script_ratios(df: DataFrame, text: str, prefix: str = "script_") -> DataFrame:
    """df with a share of each script class in kor + jpn + han + lat; zeros for texts without them and for null.

    oko, old Hangul, is a part of kor. The text is in its normal form. The steps are columns of
    their own, so that no later use of a share counts characters again.
    """
    df = df.withColumn("_c", F.regexp_replace(F.col(text), NOT_COUNTED, ""))
    df = df.withColumns({f"_n_{k}": F.coalesce(F.regexp_count("_c", F.lit(p)), F.lit(0)) for k, p in SCRIPT_CLASSES.items()})
    df = df.withColumn("_n", F.col("_n_kor") + F.col("_n_jpn") + F.col("_n_han") + F.col("_n_lat"))
    df = df.withColumns({prefix + k: F.when(F.col("_n") > 0, F.col(f"_n_{k}").cast("double") / F.col("_n")).otherwise(F.lit(0.0)) for k in SCRIPTS})
    return df.drop("_c", "_n", *(f"_n_{k}" for k in SCRIPTS))


def valid_script_counts(c: Column) -> Column:
    """struct(n_all, n_valid, n_other): characters but numbers and blanks, those of the five classes, and the others."""
    kept = F.regexp_replace(c, r"[\p{N}\p{Zs}]", "")
    every = F.coalesce(F.char_length(kept), F.lit(0))
    valid = F.coalesce(F.regexp_count(kept, F.lit("|".join(SCRIPT_CLASSES.values()))), F.lit(0))
    return F.struct(every.alias("n_all"), valid.alias("n_valid"), (every - valid).alias("n_other"))
