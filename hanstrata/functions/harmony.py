"""Column functions on vowels and harmony, all of them built-in expressions."""

from __future__ import annotations

import unicodedata
from functools import cache
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from hanstrata.functions import inventory as V


def vowels(token: Column, map_araea_i: bool = False) -> Column:
    """The vowels of a token, in order, as letters: of syllables the medial, of jamo those that are vowels.

    Conjoining vowels outside the inventory stay as they are. So does the conjoining form of ㆎ,
    unless map_araea_i is set: the stored normal form makes it of the letter, and the inventory
    then has no class for it.
    """
    letters = F.array(*map(F.lit, V.VOWELS))
    known = "".join(V.VOWELS) + V.ARAEA + V.ARAEA_I

    def one(c: Column) -> Column:
        code = F.ascii(c)
        medial = F.element_at(letters, (F.expr("1") + F.floor(((code - V.FIRST_SYLLABLE) % 588) / 28)).cast("int"))
        jamo = F.element_at(letters, (code - (V.FIRST_JAMO_VOWEL - 1)).cast("int"))
        last = V.FIRST_JAMO_VOWEL + len(V.VOWELS) - 1
        out = F.when(code.between(V.FIRST_SYLLABLE, V.LAST_SYLLABLE), medial).when(code.between(V.FIRST_JAMO_VOWEL, last), jamo).when(code == V.JAMO_ARAEA, F.lit(V.ARAEA))
        if map_araea_i:
            out = out.when(code == V.JAMO_ARAEA_I, F.lit(V.ARAEA_I))
        return out.otherwise(c)

    is_vowel = lambda c: F.ascii(c).between(V.FIRST_SYLLABLE, V.LAST_SYLLABLE) | F.ascii(c).between(0x1160, 0x11A7) | F.ascii(c).between(0xD7B0, 0xD7C6) | F.lit(known).contains(c)
    characters = F.filter(F.split(token, ""), lambda c: c != "")
    return F.transform(F.filter(characters, is_vowel), one)


@cache
def _vowel_forms() -> tuple[str, str, str]:
    """Characters that stand for a vowel letter or a comma, what each stands for, and the pattern of those that stand for nothing."""
    own = "".join(V.VOWELS) + V.ARAEA + V.ARAEA_I + ","
    to = {c: letter for letter, alike in V.VOWEL_LOOKALIKES.items() for c in alike} | {c: c for c in own}
    to |= {chr(V.FIRST_JAMO_VOWEL + k): letter for k, letter in enumerate(V.VOWELS)} | {chr(V.JAMO_ARAEA): V.ARAEA, chr(V.JAMO_ARAEA_I): V.ARAEA_I}
    unseen = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x3164, *range(0xFE00, 0xFE10), 0xFFA0, *range(0xE0000, 0xE1000)}
    alike, nothing = {}, []
    for c in (*range(0xD800), *range(0xE000, 0x2FA20), *range(0xE0000, 0xE1000)):
        if c in unseen or unicodedata.category(chr(c)) in ("Cf", "Cc", "Zs", "Zl", "Zp"):
            nothing.append(c)
            continue
        form = to.get(chr(c)) or to.get(unicodedata.normalize("NFKD", chr(c)))
        if form and form != chr(c):
            alike[chr(c)] = form
    starts = [c for c, before in zip(nothing, [-2, *nothing], strict=False) if c != before + 1]
    ends = [c for c, after in zip(nothing, [*nothing[1:], -2], strict=True) if after != c + 1]
    return "".join(alike), "".join(alike.values()), "[" + "".join(f"\\x{{{a:x}}}-\\x{{{z:x}}}" for a, z in zip(starts, ends, strict=True)) + "]"


def consistent_vowels(c: Column) -> Column:
    """A comma-joined vowel sequence in the consistent form: conjoining, half-width and look-alike letters and commas as the letters, nothing unseen between them."""
    alike, letters, nothing = _vowel_forms()
    return F.when(c.rlike("^[ㅏ-ㅣㆍㆎ](,[ㅏ-ㅣㆍㆎ])*$"), c).otherwise(F.translate(F.regexp_replace(c, nothing, ""), alike, letters))


def vowel_classes(v: Column, inventory: str = "expanded") -> Column:
    """The harmony class of each vowel; OTHER for those outside the inventory."""
    if inventory not in V.INVENTORIES:
        raise ValueError(f"inventory is one of {', '.join(V.INVENTORIES)}")
    table = F.create_map(*map(F.lit, chain(*V.INVENTORIES[inventory].items())))
    return F.transform(v, lambda x: F.coalesce(F.try_element_at(table, x), F.lit(V.OTHER)))


def harmony_status(classes: Column) -> Column:
    """Status of a sequence of classes; neutral_only for the empty one."""
    kinds = F.array_distinct(F.filter(classes, lambda c: c != V.NEUTRAL))
    return (
        F.when(F.array_contains(classes, V.OTHER), "unclassifiable_due_to_other")
        .when(F.size(kinds) == 0, "neutral_only")
        .when(F.size(kinds) > 1, "disharmonic")
        .when(F.array_contains(classes, V.NEUTRAL), "harmonic_with_neutral")
        .otherwise("harmonic")
    )


def arae_flags(v: Column) -> dict[str, Column]:
    """Six 0/1 columns about arae-a and the vowels it merged with."""
    flag = lambda b: F.coalesce(b, F.lit(False)).cast("int")
    later = F.when(F.size(v) > 1, F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    has = {"has_arae_a": F.array_contains(v, "ㆍ"), "has_a": F.array_contains(v, "ㅏ"), "has_eu": F.array_contains(v, "ㅡ")}
    initial, noninitial = F.try_element_at(v, F.lit(1)) == "ㅏ", F.array_contains(later, "ㅡ")
    return {k: flag(b) for k, b in (has | {"has_initial_a": initial, "has_noninitial_eu": noninitial, "has_any_arae_related": has["has_arae_a"] | has["has_a"] | has["has_eu"]}).items()}


def event_phase(year: Column, start: int, end: int) -> Column:
    """before, during (both ends included) or after; unknown without a year. A year is cut to a whole number."""
    number = year.try_cast("double")
    whole = F.when(~F.isnan(number), number).try_cast("bigint")
    return F.when(whole.isNull(), "unknown").when(whole < start, "before").when(whole <= end, "during").otherwise("after")
