"""Stage 02: classified documents to token rows. No step of it shuffles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hanstrata.functions import harmony as H

#: Characters on either side of a token that tell its context.
CONTEXT = 12
TOKEN = r"\p{IsHangul}+"
# One pattern for a token and what stands around it; each look-around has an empty way out, so it never fails.
# The first look-ahead keeps groups of places without a token from being filled. Groups: 1 an ideograph near to the left, 2 one right before a bracket, 3 the bracket, 4 the token, 5 the closing bracket, 6 an ideograph near to the right.
_AROUND = (
    rf"(?=\p{{IsHangul}})(?:(?<=(\p{{IsHan}})(?s:.{{0,{CONTEXT - 1}}}))|)(?:(?<=(\p{{IsHan}})\()|)(?:(?<=(\())|)"
    rf"({TOKEN})(?=(\))|)(?=(?s:.{{0,{CONTEXT - 1}}})(\p{{IsHan}})|)"
)


@dataclass(frozen=True)
class Extraction:
    """Settings of the extraction."""

    min_vowels: int = 2
    exclude_pure_hj: bool = False
    allowed_categories: tuple[str, ...] | None = None
    arae_noninitial_merger: tuple[int, int] = (1500, 1599)
    arae_initial_merger: tuple[int, int] = (1700, 1750)
    lmk_emk_transition: tuple[int, int] = (1590, 1650)
    emit_all_idu_reading_variants: bool = True
    exclude_idu_derived_wordforms: bool = True
    map_araea_i: bool = False


def keep_documents(df: DataFrame, settings: Extraction) -> DataFrame:
    keep = F.lit(True)
    if settings.exclude_pure_hj:
        keep = keep & ~F.col("category").eqNullSafe("hj")
    if settings.allowed_categories is not None:
        keep = keep & F.coalesce(F.col("category").isin(*settings.allowed_categories), F.lit(False))
    return df.where(keep)


def hangul_tokens(text: Column) -> Column:
    """The maximal runs of Hangul, in order."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def tokens_in_context(text: Column) -> Column:
    """array of struct(token, token_context): the maximal runs of Hangul and where they stand."""
    group = lambda k: F.regexp_extract_all(text, F.lit(_AROUND), F.lit(k))
    parts = F.arrays_zip(*(group(k) for k in range(1, 7)))

    def one(p: Column) -> Column:
        context = (
            F.when((p["2"] != "") & (p["4"] != "") & (p["1"] != ""), "parenthetical_hanja_reading")
            .when((p["2"] != "") & (p["4"] != ""), "parenthetical_hangul")
            .when((p["0"] != "") | (p["5"] != ""), "near_hanja")
            .otherwise("plain_hangul")
        )
        return F.struct(p["3"].alias("token"), context.alias("token_context"))

    return F.transform(parts, one)


def sino_proxy(token_source: Column, token_context: Column, language: Column, category: Column, han: Column) -> Column:
    """1 where a token probably stands in a Hanmun or Hanja text; no proof of its origin."""
    number = han.try_cast("double")
    signs = (token_source == "idu_dictionary_hangul_correspondence", token_context == "parenthetical_hanja_reading", language == "Hanmun", category.isin("hj", "hj+ko", "hj+oko"), (number > 0) & ~F.isnan(number))
    out = F.lit(False)
    for sign in signs:
        out = out | F.coalesce(sign, F.lit(False))
    return out.cast("int")


def with_vowel_columns(df: DataFrame, v: str = "v") -> DataFrame:
    """df with everything that a token row says of its vowels, the array `v`; lists are joined by commas.

    The classes are columns first, so that each use of them does not make them again.
    """
    df = df.withColumns({"_core": H.vowel_classes(F.col(v), "core"), "_expanded": H.vowel_classes(F.col(v), "expanded")})
    df = df.withColumns({"harmony_status_core": H.harmony_status(F.col("_core")), "harmony_status_expanded": H.harmony_status(F.col("_expanded")), "vowel_classes_expanded": F.array_join("_expanded", ",")})
    return df.withColumns({
        "vowels": F.array_join(v, ","), "vowel_classes_core": F.array_join("_core", ","), "vowel_classes": F.col("vowel_classes_expanded"), "num_vowels": F.size(v), "harmony_status": F.col("harmony_status_expanded"),
    } | H.arae_flags(F.col(v))).drop("_core", "_expanded")


#: The columns of a token row, in order.
COLUMNS = (
    "input_file", "doc_id", "year", "arae_noninitial_phase", "arae_initial_phase", "lmk_emk_transition_phase", "source", "corpus", "language", "language_score", "category", "script", "script_kor", "script_oko", "script_han",
    "token", "token_source", "token_context", "sino_proxy", "vowels", "vowel_classes_core", "harmony_status_core", "vowel_classes_expanded", "harmony_status_expanded", "vowel_classes", "num_vowels", "harmony_status",
    "has_arae_a", "has_a", "has_eu", "has_initial_a", "has_noninitial_eu", "has_any_arae_related",
    "idu_match_text", "idu_match_start", "idu_match_end", "idu_dictionary_sequence", "idu_hanja_text", "idu_hangul_text_raw", "idu_hangul_reading_used", "idu_reading_source_note", "idu_is_general_exclusion", "idu_is_noun_exclusion",
)


def _rows(candidates: DataFrame, settings: Extraction) -> DataFrame:
    """Token rows of candidates (document columns, token, token_source, token_context, v, idu_...)."""
    year = F.col("year")
    derived = {
        "doc_id": F.col("id"),
        "arae_noninitial_phase": H.event_phase(year, *settings.arae_noninitial_merger),
        "arae_initial_phase": H.event_phase(year, *settings.arae_initial_merger),
        "lmk_emk_transition_phase": H.event_phase(year, *settings.lmk_emk_transition),
        "sino_proxy": sino_proxy(F.col("token_source"), F.col("token_context"), F.col("language"), F.col("category"), F.col("script_han")),
    }
    candidates = with_vowel_columns(candidates)
    for c in COLUMNS:
        if c.startswith("idu_is_"):
            derived[c] = F.coalesce(F.col(c).cast("int"), F.lit(0)) if c in candidates.columns else F.lit(0)
        elif c.startswith("idu_"):
            derived[c] = F.col(c) if c in candidates.columns else F.lit(None).cast("int" if c.endswith(("start", "end")) else "string")
    if "input_file" not in candidates.columns:
        derived["input_file"] = F.lit(None).cast("string")
    return candidates.select(*(derived.get(c, F.col(c)).alias(c) for c in COLUMNS))


def hangul_rows(docs: DataFrame, settings: Extraction = Extraction()) -> DataFrame:
    """A row for each token of enough vowels in the kept documents."""
    found = keep_documents(docs, settings).where(F.col("text").isNotNull()).withColumn("_t", F.explode(tokens_in_context(F.col("text"))))
    found = found.withColumns({"token": F.col("_t.token"), "token_context": F.col("_t.token_context"), "token_source": F.lit("original_hangul_token")})
    found = found.withColumn("v", H.vowels(F.col("token"), settings.map_araea_i)).where(F.size("v") >= settings.min_vowels)
    return _rows(found, settings)


def idu_candidates(docs: DataFrame, lexicon, settings: Extraction = Extraction()) -> DataFrame:
    """A row for each reading of each dictionary match that has enough vowels, whether or not readings are excluded."""
    from hanstrata.operators.lexicon import match_column, reading_column

    found = keep_documents(docs, settings).where(F.col("text").isNotNull())
    found = found.withColumn("_m", F.explode(match_column(lexicon, docs.sparkSession)(F.col("text"))))
    entries = F.col("_m.entries") if settings.emit_all_idu_reading_variants else F.slice("_m.entries", 1, 1)
    found = found.withColumn("_e", F.explode(entries)).withColumn("_r", F.explode(reading_column(F.col("_e.hangul_text"))))
    return found.withColumn("v", H.vowels(F.col("_r.reading"), settings.map_araea_i)).where(F.size("v") >= settings.min_vowels)


def idu_rows(docs: DataFrame, lexicon, settings: Extraction = Extraction()) -> DataFrame:
    """Token rows of idu_candidates(); none if readings are excluded."""
    found = idu_candidates(docs, lexicon, settings).where(F.lit(not settings.exclude_idu_derived_wordforms))
    found = found.withColumns({
        "token": F.col("_r.reading"), "token_source": F.lit("idu_dictionary_hangul_correspondence"), "token_context": F.lit("idu_dictionary_match"),
        "idu_match_text": F.col("_m.match_text"), "idu_match_start": F.col("_m.start"), "idu_match_end": F.col("_m.end"), "idu_dictionary_sequence": F.col("_e.sequence"),
        "idu_hanja_text": F.col("_e.hanja_text"), "idu_hangul_text_raw": F.col("_e.hangul_text"), "idu_hangul_reading_used": F.col("_r.reading"), "idu_reading_source_note": F.col("_r.note"),
        "idu_is_general_exclusion": F.col("_e.is_general_exclusion"), "idu_is_noun_exclusion": F.col("_e.is_noun_exclusion"),
    })
    return _rows(found, settings)


def counts(docs: DataFrame, settings: Extraction = Extraction(), lexicon=None) -> DataFrame:
    """One row: documents_used, hangul_rows, idu_matches, idu_rows_emitted and idu_rows_suppressed of an extraction."""
    from hanstrata.operators.lexicon import match_column

    kept = keep_documents(docs, settings).where(F.col("text").isNotNull())
    enough = F.size(F.filter(hangul_tokens(F.col("text")), lambda t: F.size(H.vowels(t, settings.map_araea_i)) >= settings.min_vowels))
    zero = F.lit(0).cast("bigint")
    out = kept.agg(F.count("*").alias("documents_used"), F.coalesce(F.sum(enough), zero).alias("hangul_rows"), zero.alias("idu_matches"), zero.alias("idu_rows"))
    if lexicon is not None:
        matched = kept.agg(zero.alias("documents_used"), zero.alias("hangul_rows"), F.coalesce(F.sum(F.size(match_column(lexicon, docs.sparkSession)(F.col("text")))), zero).alias("idu_matches"), zero.alias("idu_rows"))
        out = out.unionByName(matched).unionByName(idu_candidates(docs, lexicon, settings).agg(zero.alias("documents_used"), zero.alias("hangul_rows"), zero.alias("idu_matches"), F.count("*").alias("idu_rows")))
    out = out.agg(*(F.sum(c).alias(c) for c in ("documents_used", "hangul_rows", "idu_matches", "idu_rows")))
    emitted = F.lit(0 if settings.exclude_idu_derived_wordforms else 1)
    return out.select("documents_used", "hangul_rows", "idu_matches", (F.col("idu_rows") * emitted).alias("idu_rows_emitted"), (F.col("idu_rows") * (1 - emitted)).alias("idu_rows_suppressed"))


def token_rows(docs: DataFrame, settings: Extraction = Extraction(), lexicon=None) -> DataFrame:
    """All token rows of classified documents."""
    rows = hangul_rows(docs, settings)
    if lexicon is None or settings.exclude_idu_derived_wordforms:
        return rows
    return rows.unionByName(idu_rows(docs, lexicon, settings))
