"""Queries of the analysis stages over the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hanstrata.functions import harmony as H
from hanstrata.functions import inventory as V
from hanstrata.functions import text as X
from hanstrata.operators import documents as D
from hanstrata.operators import language_id, learning, lexicon, pairs, sampling, tokens
from hanstrata.runtime import checkpoint, remove, table, work_path
from hanstrata.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- texts ----

_WS = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WS_LINE = _WS.replace(r"\t-\r", r"\t\x{0b}-\r")
_STRIP = rf"[{_WS}\x{{1c}}-\x{{1f}}]"


def _replace(c: str, pattern: str, to: str = "''") -> str:
    return f"regexp_replace({c}, '{pattern}', {to}, 'g')"


def _strip_sql(c: str) -> str:
    return _replace(_replace(c, f"^{_STRIP}+"), f"{_STRIP}+$")


_SQUEEZED = _strip_sql(_replace(_replace(_replace("text", rf"[{_WS_LINE}]*\n[{_WS_LINE}]*", "chr(10)"), r"\n+", "chr(10)"), rf"[{_WS_LINE}]+", "' '"))
_UNCONTROLLED = _replace("text", r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}]")


@query(f"SELECT id, {_SQUEEZED} AS squeezed, {_strip_sql(_replace('text', f'[{_WS}]+', chr(39) + ' ' + chr(39)))} AS one_line FROM raw_documents")
def squeeze_whitespace(spark, folder):
    return table(spark, folder, "raw_documents").select("id", X.squeeze_space(F.col("text")).alias("squeezed"), X.squeeze_space(F.col("text"), keep_lines=False).alias("one_line"))


@query(f"SELECT id, {_UNCONTROLLED} AS stripped FROM raw_documents")
def control_strip(spark, folder):
    return table(spark, folder, "raw_documents").select("id", X.remove_controls(F.col("text")).alias("stripped"))


_OLD = r"\x{1100}-\x{11FF}\x{A960}-\x{A97F}\x{D7B0}-\x{D7FF}\x{302E}-\x{302F}\x{E0BC}-\x{EFFF}\x{F100}-\x{F66E}\x{F784}-\x{F800}\x{F806}-\x{F864}\x{F86A}-\x{F8F7}\x{E001}-\x{E0A0}"
_CLASS = {"kor": rf"\p{{Hangul}}\x{{3130}}-\x{{318F}}{_OLD}", "oko": _OLD, "jpn": r"\p{Hiragana}\p{Katakana}", "han": r"\p{Han}", "lat": r"\p{Latin}"}
_CLEANED = _replace("text", rf"[\p{{P}}\p{{Z}}{_WS}\p{{Nd}}\x{{119E}}\x{{318D}}]+")


def _profile_sql(source: str) -> str:
    total = "n_kor + n_jpn + n_han + n_lat"
    return f"""
    counted AS (SELECT *, {', '.join(f"length({_replace('cleaned', f'[^{c}]')}) AS n_{k}" for k, c in _CLASS.items())}
                FROM (SELECT *, {_CLEANED} AS cleaned FROM {source})),
    profiled AS (SELECT * EXCLUDE (cleaned), {', '.join(f"CASE WHEN {total} > 0 THEN n_{k} / ({total})::DOUBLE ELSE 0 END AS {k}" for k in _CLASS)} FROM counted)"""


_PROFILE = _profile_sql("raw_documents")


@query(f"WITH {_PROFILE} SELECT id, {', '.join(f'round({k}, 9) AS {k}' for k in _CLASS)} FROM profiled")
def script_ratios(spark, folder):
    found = X.with_script_ratios(table(spark, folder, "raw_documents"), "text", "_r_")
    return found.select("id", *(F.round(f"_r_{k}", 9).alias(k) for k in _CLASS))


_KEPT = _replace("text", r"[\p{N}\p{Zs}]")


@query(f"""
    SELECT id, n_all, n_valid, n_all - n_valid AS n_other FROM (
      SELECT id, coalesce(length(kept), 0) AS n_all, coalesce(length({_replace('kept', '[^' + ''.join(_CLASS.values()) + ']')}), 0) AS n_valid FROM (SELECT id, {_KEPT} AS kept FROM raw_documents))""")
def valid_script_counts(spark, folder):
    return table(spark, folder, "raw_documents").select("id", X.valid_script_counts(F.col("text")).alias("n")).select("id", *(F.col(f"n.{k}").cast("bigint").alias(k) for k in ("n_all", "n_valid", "n_other")))


_NO_LETTER = r"[^\p{L}]"


def _compatible() -> str:
    """VALUES of all characters with a compatibility decomposition, and what each becomes; DuckDB itself does the canonical part."""
    tagged = (c for c in map(chr, (*range(0xA0, 0xD800), *range(0xE000, 0x1FBFA))) if unicodedata.decomposition(c).startswith("<") or unicodedata.normalize("NFKD", c) != unicodedata.normalize("NFD", c))
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    return ", ".join(f"({quoted(c)}, {quoted(unicodedata.normalize('NFKD', c))})" for c in tagged)


def _normal_sql(source: str) -> str:
    """CTEs up to `composed` (the compatibility composition) and `normal` (the stored form) of the texts of a table; `rid` numbers its rows."""
    return f"""
    numbered AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM {source}),
    spelled AS (SELECT rid, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM numbered WHERE text <> ''),
    forms AS (SELECT rid, nfc_normalize(string_agg(coalesce(form, c), '' ORDER BY i)) AS form FROM spelled LEFT JOIN (VALUES {_compatible()}) AS k(given, form) ON c = given GROUP BY rid),
    composed AS (SELECT numbered.* REPLACE (coalesce(form, text) AS text) FROM numbered LEFT JOIN forms USING (rid)),
    squeezed AS (SELECT * REPLACE ({_SQUEEZED} AS text) FROM composed),
    normal AS MATERIALIZED (SELECT * REPLACE ({_UNCONTROLLED} AS text) FROM squeezed)"""


@query(f"WITH {_normal_sql('raw_documents')} SELECT id, text FROM normal")
def normalized_texts(spark, folder):
    """The texts that stage 01 stores, by its own pass over them."""
    return X.with_normal_text(table(spark, folder, "raw_documents")).select("id", "text")


@query(f"WITH {_normal_sql('raw_documents')} SELECT id, {_replace('text', _NO_LETTER)} AS letters FROM composed")
def letters_only(spark, folder):
    return table(spark, folder, "raw_documents").select("id", X.letters_only(F.col("text")).alias("letters"))


# ---- documents ----

_NUM = rf"^[\p{{N}}\p{{P}}\p{{Z}}{_WS}]+$"
_GLOSS = r"(?:\p{Hangul}+[\t-\r ]*[(\[]\p{Han}+[)\]]|\p{Han}+[\t-\r ]*[(\[]\p{Hangul}+[)\]])"
_CATEGORY = f"""
    stripped AS (SELECT *, split_part(id, ':', 1) AS src, {_strip_sql('text')} AS bare,
                        coalesce(list_sum(list_transform(regexp_extract_all(text, '{_GLOSS}'), lambda g: length(g))), 0) AS glossed FROM profiled),
    ruled AS (SELECT *, CASE
        WHEN regexp_matches(bare, '{_NUM}') THEN 'num' WHEN bare = '' THEN 'empty'
        WHEN src IN ('bibyeonsa', 'goryeosa', 'ilseongnok', 'sagi', 'sillok', 'sjw') THEN 'hj'
        WHEN src IN ('kisu_journal', 'kisu_literary') THEN 'nko'
        WHEN src = 'kcna_jp' THEN CASE language WHEN 'kor_Hang' THEN 'nko' WHEN 'eng_Latn' THEN 'en' WHEN 'spa_Latn' THEN 'es' END
        WHEN src IN ('klc', 'gaksa', 'gaksa_modern') THEN CASE
            WHEN han >= 1 THEN 'hj' WHEN kor > 0 AND han > 0 AND oko = 0 THEN CASE WHEN contains(text, '주-D') THEN 'hj' ELSE 'hj+oko' END
            WHEN oko > 0 THEN 'hj+oko' WHEN kor > 0 AND han = 0 THEN 'ko' WHEN jpn > 0 AND kor = 0 THEN 'ja' ELSE 'hj' END
        WHEN src = 'jpn_records' THEN CASE
            WHEN language IN ('jpn_Jpan', 'zho_Hani') AND jpn > 0 THEN 'ja' WHEN language = 'eng_Latn' AND lat > 0 THEN 'en' WHEN language = 'fra_Latn' AND lat > 0 THEN 'fr'
            WHEN jpn > 0 THEN 'hj' WHEN oko > 0 AND han > 0 THEN 'hj+oko' WHEN oko > 0 THEN 'oko'
            WHEN kor > 0 AND han > 0 THEN CASE WHEN contains(text, '문서제목') THEN 'hj' ELSE 'hj+ko' END WHEN kor > 0 THEN 'ko' ELSE 'hj' END
        WHEN src = 'magazine' THEN CASE
            WHEN language = 'jpn_Jpan' AND jpn > 0 THEN 'ja' WHEN han >= 1 THEN 'hj' WHEN han > 0 AND kor > 0 AND oko = 0 THEN 'hj+ko' WHEN han > 0 AND oko > 0 THEN 'hj+oko'
            WHEN language = 'eng_Latn' AND lat > 0 THEN 'en' WHEN oko > 0 THEN 'oko' WHEN kor > 0 AND han = 0 THEN 'ko' WHEN jpn > 0 THEN 'ja' ELSE 'hj' END
        WHEN src IN ('news_archive', 'newslibrary') THEN CASE
            WHEN han >= 1 THEN 'hj' WHEN han > 0 AND kor > 0 AND oko = 0 THEN 'hj+ko' WHEN han > 0 AND oko > 0 THEN 'hj+oko' WHEN kor > 0 AND han = 0 THEN 'ko' WHEN oko > 0 THEN 'oko'
            WHEN language = 'eng_Latn' AND lat > 0 THEN 'en' WHEN jpn > 0 THEN 'ja' WHEN lat >= 1 THEN 'en' WHEN lat > 0 AND han > 0 THEN 'hj+en' ELSE 'zxx' END
        WHEN src = 'gongu' THEN CASE
            WHEN glossed > 0 AND glossed / length(text) >= 0.7 THEN 'hj' WHEN kor > 0 AND han = 0 AND oko = 0 THEN 'ko' WHEN oko > 0 AND han = 0 THEN 'oko' WHEN jpn > 0 AND kor = 0 AND oko = 0 THEN 'ja'
            WHEN han > 0 AND kor = 0 AND oko = 0 THEN 'hj' WHEN language = 'eng_Latn' AND lat > 0 THEN 'en' WHEN han > 0 AND kor > 0 AND oko = 0 THEN 'hj+ko' WHEN han > 0 AND oko > 0 THEN 'hj+oko' ELSE 'unk' END
        WHEN src IN ('aks_book', 'aks_collection', 'aks_letter', 'aks_royal', 'kyu_old', 'nhm_archive') THEN CASE
            WHEN han >= 1 THEN 'hj' WHEN han > 0 AND oko > 0 THEN 'hj+oko' WHEN han > 0 AND kor > 0 AND oko = 0 THEN CASE WHEN src IN ('kyu_old', 'aks_collection') THEN 'hj' ELSE 'hj+ko' END
            WHEN oko > 0 THEN 'oko' WHEN kor > 0 AND han = 0 THEN 'ko' WHEN language = 'jpn_Jpan' AND jpn > 0 THEN 'ja' WHEN language = 'eng_Latn' AND lat > 0 THEN 'en'
            WHEN han > 0 AND kor = 0 AND oko = 0 THEN 'hj' ELSE 'zxx' END
        END AS category FROM stripped)"""


def _category(df: DataFrame) -> DataFrame:
    found = X.with_script_ratios(df, "text")
    return found.withColumn("category", D.category(D.source_id(F.col("id")), D.shares(), F.col("language"), F.col("text")))


@query(f"WITH {_PROFILE}, {_CATEGORY} SELECT id, category FROM ruled")
def document_categories(spark, folder):
    return _category(table(spark, folder, "raw_documents")).select("id", "category")


_KEPT = """
    kept AS (SELECT *, CASE WHEN contains(category, 'ko') AND year < 1446 THEN replace(replace(category, '+oko', ''), '+ko', '') ELSE category END AS c FROM ruled WHERE category IS NULL OR category NOT IN ('empty', 'num', 'zxx'))"""
_PERIOD_LANGUAGE = """
      CASE WHEN c IN ('oko', 'hj+oko', 'hj+ko', 'ko') THEN CASE WHEN year IS NULL THEN 'Korean' WHEN year >= 918 AND year < 1600 THEN CASE WHEN han > 0.8 THEN 'Hanmun' ELSE 'Middle Korean' END
             WHEN year >= 1600 AND year < 1894 THEN 'Early Modern Korean' WHEN year >= 1894 THEN 'Modern Korean' END
           ELSE CASE c WHEN 'hj' THEN 'Hanmun' WHEN 'hj+en' THEN 'Hanmun' WHEN 'nko' THEN 'North Korean' WHEN 'en' THEN 'English' WHEN 'ja' THEN 'Japanese' WHEN 'es' THEN 'Spanish' WHEN 'fr' THEN 'French' END END"""
_CATEGORY_SCRIPT = """
      CASE c WHEN 'hj' THEN 'Hanja' WHEN 'hj+oko' THEN 'Hanja, Old Hangeul' WHEN 'hj+ko' THEN 'Hanja, Hangeul' WHEN 'nko' THEN 'Hangeul' WHEN 'ko' THEN 'Hangeul' WHEN 'en' THEN 'Latin' WHEN 'ja' THEN 'Kanji, Kana'
             WHEN 'es' THEN 'Latin' WHEN 'hj+en' THEN 'Hanja, Latin' WHEN 'oko' THEN 'Old Hangeul' WHEN 'fr' THEN 'Latin' END"""


@query(f"WITH {_PROFILE}, {_CATEGORY}, {_KEPT} SELECT id, c AS category, {_PERIOD_LANGUAGE} AS language, {_CATEGORY_SCRIPT} AS script FROM kept")
def classified_documents(spark, folder):
    df = _category(table(spark, folder, "raw_documents")).where(~F.coalesce(F.col("category").isin(*D.DROPPED), F.lit(False)))
    df = df.withColumn("category", D.before_hangul(F.col("category"), F.col("year")))
    return df.select("id", "category", D.period_language(F.col("category"), F.col("year"), F.col("script_han")).alias("language"), D.category_script(F.col("category")).alias("script"))


def _words_sql(language: str) -> str:
    listed = ", ".join(f"'{w}'" for w in X.FREQUENT_WORDS[language])
    return f"len(list_filter(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]+'), lambda x: lower(x) IN ({listed})))"


def _processed_sql(source: str) -> str:
    """CTEs up to `kept`: stage 01 as a whole, told by scripts and frequent words."""
    return f"""{_normal_sql(source)}, {_profile_sql('normal')},
    worded AS (SELECT *, {', '.join(f"{_words_sql(x)} AS {x[:3]}" for x in X.FREQUENT_WORDS)}, greatest(kor, jpn, han, lat) AS best FROM profiled),
    told AS (SELECT *, CASE WHEN best <= 0 THEN NULL WHEN kor = best THEN 'kor_Hang' WHEN jpn = best THEN 'jpn_Jpan' WHEN han = best THEN 'cmn_Hani' WHEN eng >= fra AND eng >= spa THEN 'eng_Latn' WHEN fra >= spa THEN 'fra_Latn' ELSE 'spa_Latn' END AS first_language,
                    CASE WHEN lat = best AND kor < best AND jpn < best AND han < best THEN best * ((greatest(eng, fra, spa) + 1) / (eng + fra + spa + 3)::DOUBLE) ELSE best END AS first_score,
                    CASE WHEN lat <= 0 AND jpn <= 0 THEN NULL WHEN lat >= jpn THEN CASE WHEN eng >= fra THEN 'eng_Latn' ELSE 'fra_Latn' END ELSE 'jpn_Jpan' END AS record_language,
                    CASE WHEN lat >= jpn THEN lat * ((greatest(eng, fra) + 1) / (eng + fra + 2)::DOUBLE) ELSE jpn END AS record_score, split_part(id, ':', 1) = 'jpn_records' AND length(text) > 0 AS again FROM worded),
    identified AS (SELECT * REPLACE (CASE WHEN again THEN coalesce(record_language, first_language) ELSE first_language END AS language), CASE WHEN again THEN record_score ELSE first_score END AS language_score FROM told),
    {_CATEGORY.replace('FROM profiled', 'FROM identified')}, {_KEPT}"""


_SCRIPT_COLUMNS = ", ".join(f"{k} AS script_{k}" for k in _CLASS)


@query(f"WITH {_processed_sql('raw_documents')} SELECT id, text, year, {_PERIOD_LANGUAGE} AS language, {_CATEGORY_SCRIPT} AS script, source, corpus, received_at, {_SCRIPT_COLUMNS}, language_score, c AS category FROM kept")
def processed_documents(spark, folder):
    """Stage 01 as a whole: normal texts, profiles, languages and categories."""
    return D.classify(D.profile(table(spark, folder, "raw_documents")))


# ---- tokens and vowels ----


@query(r"SELECT token, count(*) AS n_tokens FROM (SELECT unnest(regexp_extract_all(text, '\p{Hangul}+')) AS token FROM raw_documents) GROUP BY token")
def hangul_tokens(spark, folder):
    found = table(spark, folder, "raw_documents").select(F.explode(tokens.hangul_tokens(F.col("text"))).alias("token"))
    return found.groupBy("token").agg(F.count("*").alias("n_tokens"))


_HANGUL_CHAR, _HAN_CHAR = r"regexp_full_match(c, '\p{Hangul}')", r"regexp_full_match(c, '\p{Han}')"


def _tokens_sql(source: str) -> str:
    """CTE `tokens` (rid, n, token, token_context): runs of Hangul by the places of their characters in `source` (rid, text)."""
    return f"""
    placed AS (SELECT rid, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM {source} WHERE text <> ''),
    flagged AS (SELECT *, {_HANGUL_CHAR} AS hangul, {_HAN_CHAR} AS hanja FROM placed),
    around AS (SELECT *, lag(hangul, 1, false) OVER o AS within, lag(c) OVER o AS before, lag(hanja, 2, false) OVER o AS hanja_before, lead(c) OVER o AS after,
                      bool_or(hanja) OVER (o ROWS BETWEEN {tokens.CONTEXT} PRECEDING AND 1 PRECEDING) AS left_hanja, bool_or(hanja) OVER (o ROWS BETWEEN 1 FOLLOWING AND {tokens.CONTEXT} FOLLOWING) AS right_hanja
               FROM flagged WINDOW o AS (PARTITION BY rid ORDER BY i)),
    runs AS (SELECT *, sum(CASE WHEN hangul AND NOT within THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS n FROM around),
    ends AS (SELECT rid, n, string_agg(c, '' ORDER BY i) AS token, arg_min(before, i) = '(' AND arg_max(coalesce(after, ''), i) = ')' AS bracketed, arg_min(hanja_before, i) AS hanja_before,
                    coalesce(arg_min(coalesce(left_hanja, false), i), false) OR coalesce(arg_max(coalesce(right_hanja, false), i), false) AS near FROM runs WHERE hangul GROUP BY rid, n),
    tokens AS (SELECT rid, n, token, CASE WHEN bracketed AND hanja_before THEN 'parenthetical_hanja_reading' WHEN bracketed THEN 'parenthetical_hangul' WHEN near THEN 'near_hanja' ELSE 'plain_hangul' END AS token_context FROM ends)"""


@query(f"WITH numbered AS MATERIALIZED (SELECT id, text, row_number() OVER () AS rid FROM raw_documents), {_tokens_sql('numbered')} SELECT id, token_context, count(*) AS n_tokens FROM tokens JOIN numbered USING (rid) GROUP BY id, token_context")
def token_contexts(spark, folder):
    found = table(spark, folder, "raw_documents").select("id", F.explode(tokens.tokens_in_context(F.col("text"))).alias("t"))
    return found.groupBy("id", "t.token_context").agg(F.count("*").alias("n_tokens"))


_CODE = "unicode(c)"
_LETTERS = "'ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ'"
_IS_VOWEL = f"({_CODE} BETWEEN 44032 AND 55203 OR {_CODE} BETWEEN 4448 AND 4519 OR {_CODE} BETWEEN 55216 AND 55238 OR contains({_LETTERS} || 'ㆍㆎ', c))"
_ONE_VOWEL = f"CASE WHEN {_CODE} BETWEEN 44032 AND 55203 THEN {_LETTERS}[((({_CODE} - 44032) % 588) // 28) + 1] WHEN {_CODE} BETWEEN 4449 AND 4469 THEN {_LETTERS}[{_CODE} - 4448] WHEN {_CODE} = 4510 THEN 'ㆍ' ELSE c END"


@query(f"""
    SELECT token, array_to_string(list_transform(list_filter(string_split(token, ''), lambda c: c <> '' AND {_IS_VOWEL}), lambda c: {_ONE_VOWEL}), ',') AS vowels
    FROM (SELECT DISTINCT token FROM token_rows WHERE token IS NOT NULL)""")
def vowel_sequences(spark, folder):
    found = table(spark, folder, "token_rows").where(F.col("token").isNotNull()).select("token").distinct()
    return found.select("token", F.array_join(H.vowels(F.col("token")), ",").alias("vowels"))


_CLEAN = "regexp_matches(vowels, '^[ㅏ-ㅣㆍㆎ](,[ㅏ-ㅣㆍㆎ])*$')"


def _clean_vowels(spark, folder) -> DataFrame:
    return table(spark, folder, "token_rows").where(F.col("vowels").rlike("^[ㅏ-ㅣㆍㆎ](,[ㅏ-ㅣㆍㆎ])*$")).withColumn("v", F.split("vowels", ","))


@query(f"SELECT token_row_id, vowel_classes_core, harmony_status_core, vowel_classes_expanded, harmony_status_expanded, vowel_classes, num_vowels, harmony_status FROM token_rows WHERE {_CLEAN}")
def vowel_classes(spark, folder):
    made = tokens.with_vowel_columns(_clean_vowels(spark, folder).select("token_row_id", "v"))
    return made.select("token_row_id", *(c for c in ("vowel_classes_core", "harmony_status_core", "vowel_classes_expanded", "harmony_status_expanded", "vowel_classes", "num_vowels", "harmony_status")))


@query(f"SELECT token_row_id, has_arae_a, has_a, has_eu, has_initial_a, has_noninitial_eu, greatest(has_arae_a, has_a, has_eu) AS has_any_arae_related FROM token_rows WHERE {_CLEAN}")
def arae_flags(spark, folder):
    return _clean_vowels(spark, folder).select("token_row_id", *(c.alias(k) for k, c in H.arae_flags(F.col("v")).items()))


def _all_vowels(spark, folder) -> DataFrame:
    """Also the rows whose vowels are written with other characters."""
    return table(spark, folder, "token_rows").where(F.col("vowels").isNotNull()).withColumn("v", F.split(H.consistent_vowels(F.col("vowels")), ","))


@query("SELECT token_row_id, vowel_classes_core, harmony_status_core, vowel_classes_expanded, harmony_status_expanded, vowel_classes, num_vowels, harmony_status FROM token_rows WHERE vowels IS NOT NULL")
def vowel_classes_all_rows(spark, folder):
    made = tokens.with_vowel_columns(_all_vowels(spark, folder).select("token_row_id", "v"))
    return made.select("token_row_id", "vowel_classes_core", "harmony_status_core", "vowel_classes_expanded", "harmony_status_expanded", "vowel_classes", "num_vowels", "harmony_status")


@query("SELECT token_row_id, has_arae_a, has_a, has_eu, has_initial_a, has_noninitial_eu, greatest(has_arae_a, has_a, has_eu) AS has_any_arae_related FROM token_rows WHERE vowels IS NOT NULL")
def arae_flags_all_rows(spark, folder):
    return _all_vowels(spark, folder).select("token_row_id", *(c.alias(k) for k, c in H.arae_flags(F.col("v")).items()))


def _phase_sql(start: int, end: int) -> str:
    return f"CASE WHEN year IS NULL OR isnan(year) THEN 'unknown' WHEN trunc(year) < {start} THEN 'before' WHEN trunc(year) <= {end} THEN 'during' ELSE 'after' END"


@query(f"SELECT token_row_id, {_phase_sql(1500, 1599)} AS arae_noninitial_phase, {_phase_sql(1700, 1750)} AS arae_initial_phase, {_phase_sql(1590, 1650)} AS lmk_emk_transition_phase FROM token_rows")
def event_phases(spark, folder):
    s = tokens.Extraction()
    phases = {"arae_noninitial_phase": s.arae_noninitial_merger, "arae_initial_phase": s.arae_initial_merger, "lmk_emk_transition_phase": s.lmk_emk_transition}
    return table(spark, folder, "token_rows").select("token_row_id", *(H.event_phase(F.col("year"), *b).alias(k) for k, b in phases.items()))


@query("""
    SELECT token_row_id, CASE WHEN token_source = 'idu_dictionary_hangul_correspondence' OR token_context = 'parenthetical_hanja_reading' OR language = 'Hanmun'
             OR category IN ('hj', 'hj+ko', 'hj+oko') OR script_han > 0 THEN 1 ELSE 0 END AS sino_proxy FROM token_rows""")
def sino_proxy(spark, folder):
    return table(spark, folder, "token_rows").select("token_row_id", tokens.sino_proxy(*map(F.col, ("token_source", "token_context", "language", "category", "script_han"))).alias("sino_proxy"))


def _token_rows(spark, folder) -> DataFrame:
    docs = D.classify(D.profile(table(spark, folder, "raw_documents").drop("received_at").distinct()))
    return tokens.token_rows(docs)


def _class_sql(inventory: str) -> str:
    of = {kind: ", ".join(f"'{v}'" for v, k in V.INVENTORIES[inventory].items() if k == kind) for kind in (V.PLUS, V.MINUS, V.NEUTRAL)}
    cases = " ".join(f"WHEN x IN ({listed}) THEN '{kind}'" for kind, listed in of.items())
    return f"list_transform(v, lambda x: CASE {cases} ELSE 'OTHER' END)"


def _status_sql(c: str) -> str:
    plus, minus = f"list_contains({c}, '+RTR')", f"list_contains({c}, '-RTR')"
    return f"CASE WHEN list_contains({c}, 'OTHER') THEN 'unclassifiable_due_to_other' WHEN NOT {plus} AND NOT {minus} THEN 'neutral_only' WHEN {plus} AND {minus} THEN 'disharmonic' WHEN list_contains({c}, 'NEUTRAL') THEN 'harmonic_with_neutral' ELSE 'harmonic' END"


_EXTRACTED = f"""
    voiced AS (SELECT *, list_transform(list_filter(string_split(token, ''), lambda c: c <> '' AND {_IS_VOWEL}), lambda c: {_ONE_VOWEL}) AS v FROM tokens),
    classed AS (SELECT *, {_class_sql('core')} AS core, {_class_sql('expanded')} AS expanded FROM voiced WHERE len(v) >= 2),
    documents_kept AS (SELECT rid, id, year, source, corpus, language_score, {_SCRIPT_COLUMNS}, c, {_PERIOD_LANGUAGE} AS period, {_CATEGORY_SCRIPT} AS written FROM kept)"""


@query(f"""
    WITH {_processed_sql('(SELECT DISTINCT * EXCLUDE (received_at) FROM raw_documents)')}, {_tokens_sql('kept')}, {_EXTRACTED}
    SELECT NULL::VARCHAR AS input_file, id AS doc_id, year, {_phase_sql(1500, 1599)} AS arae_noninitial_phase, {_phase_sql(1700, 1750)} AS arae_initial_phase, {_phase_sql(1590, 1650)} AS lmk_emk_transition_phase, source, corpus,
      period AS language, language_score, c AS category, written AS script, script_kor, script_oko, script_han, token, 'original_hangul_token' AS token_source, token_context,
      CASE WHEN token_context = 'parenthetical_hanja_reading' OR period = 'Hanmun' OR c IN ('hj', 'hj+ko', 'hj+oko') OR script_han > 0 THEN 1 ELSE 0 END AS sino_proxy,
      array_to_string(v, ',') AS vowels, array_to_string(core, ',') AS vowel_classes_core, {_status_sql('core')} AS harmony_status_core, array_to_string(expanded, ',') AS vowel_classes_expanded, {_status_sql('expanded')} AS harmony_status_expanded,
      array_to_string(expanded, ',') AS vowel_classes, CAST(len(v) AS INTEGER) AS num_vowels, {_status_sql('expanded')} AS harmony_status, CAST(list_contains(v, 'ㆍ') AS INTEGER) AS has_arae_a, CAST(list_contains(v, 'ㅏ') AS INTEGER) AS has_a,
      CAST(list_contains(v, 'ㅡ') AS INTEGER) AS has_eu, CAST(v[1] = 'ㅏ' AS INTEGER) AS has_initial_a, CAST(list_contains(v[2:], 'ㅡ') AS INTEGER) AS has_noninitial_eu, CAST(list_contains(v, 'ㆍ') OR list_contains(v, 'ㅏ') OR list_contains(v, 'ㅡ') AS INTEGER) AS has_any_arae_related,
      {', '.join(f"NULL::{'INTEGER' if c.endswith(('start', 'end')) else 'VARCHAR'} AS {c}" for c in tokens.COLUMNS if c.startswith('idu_') and not c.startswith('idu_is_'))}, 0 AS idu_is_general_exclusion, 0 AS idu_is_noun_exclusion
    FROM classed JOIN documents_kept USING (rid)""")
def extracted_token_rows(spark, folder):
    """Stages 01 and 02: token rows of raw documents, all columns."""
    return _token_rows(spark, folder)


# ---- windows and samples ----

_SETTINGS = sampling.Sampling(min_window_wordforms=100, target_wordforms_per_window=50)
_STRICT = sampling.Sampling(sampling_mode="strict-balanced", min_window_wordforms=20, min_window_tokens=50, exclude_windows=("1893-1992",))
_ROWS = f"""
    cleaned AS (SELECT *, CAST(trunc(year) AS INTEGER) AS y, {_strip_sql('token')} AS t, list_filter(list_transform(string_split(vowels, ','), lambda v: {_strip_sql('v')}), lambda v: v <> '') AS v FROM token_rows
                WHERE year IS NOT NULL AND year >= 1443 AND token IS NOT NULL AND vowels IS NOT NULL),
    usable AS (SELECT *, array_to_string(v, ' ') AS vs, t || ' || ' || array_to_string(v, ' ') AS wf FROM cleaned WHERE t <> '' AND len(v) BETWEEN 2 AND 5),
    windowed AS (SELECT *, s AS ws, s + 99 AS we, s || '-' || (s + 99) AS wid FROM (
                   SELECT *, unnest([x for x in [1443 + ((y - 1443) // 50) * 50 - 50, 1443 + ((y - 1443) // 50) * 50] if x >= 1443 and x + 99 >= y]) AS s FROM usable)),
    counted AS (SELECT ws AS time_window_start, we AS time_window_end, wid AS time_window_id, wf AS wordform_id, t AS token, vs AS vowel_seq, count(*) AS token_count_in_window,
                       min(y) AS first_observed_year_in_window, max(y) AS last_observed_year_in_window, CAST(min(len(v)) AS INTEGER) AS num_vowels_normalized,
                       array_to_string(list_sort(list(DISTINCT coalesce(token_source, 'nan'))), '|') AS token_sources_present, bool_or(contains(lower(coalesce(token_source, '')), 'idu')) AS contains_idu_derived_observation,
                       min(vowel_classes_core) AS vowel_classes_core, min(harmony_status_core) AS harmony_status_core, min(vowel_classes_expanded) AS vowel_classes_expanded, min(harmony_status_expanded) AS harmony_status_expanded
                FROM windowed GROUP BY ALL)"""


def _counts(spark, folder) -> DataFrame:
    return sampling.count_wordforms(table(spark, folder, "token_rows"), _SETTINGS)


@query(f"WITH {_ROWS} SELECT * FROM counted")
def wordform_counts(spark, folder):
    return _counts(spark, folder)


@query("SELECT CAST(trunc(min(year)) - (trunc(min(year)) % 25) AS INTEGER) AS anchor_year FROM token_rows WHERE NOT isnan(year)")
def anchor_year(spark, folder):
    found = sampling.anchor_year(table(spark, folder, "token_rows"), sampling.Sampling(start_year=None, window_width=25, window_step=25))
    return spark.createDataFrame([(found,)], "anchor_year int")


def _years_sql(width: int, step: int) -> str:
    back = ", ".join(f"1443 + ((y - 1443) // {step}) * {step} - {k * step}" for k in range(-(-width // step)))
    return f"""SELECT y AS year, s AS window_start, s + {width - 1} AS window_end FROM (
      SELECT y, unnest([x for x in [{back}] if x >= 1443 and x + {width - 1} >= y]) AS s FROM (SELECT DISTINCT CAST(trunc(year) AS INTEGER) AS y FROM token_rows WHERE year >= 1443))"""


def _years(spark, folder, width: int, step: int) -> DataFrame:
    years = table(spark, folder, "token_rows").where("year >= 1443").select(F.col("year").cast("int").alias("year")).distinct()
    found = years.select("year", F.explode(sampling.year_windows(F.col("year"), 1443, width, step)).alias("w"))
    return found.select("year", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"))


@query(_years_sql(25, 25))
def year_windows_tumbling(spark, folder):
    return _years(spark, folder, 25, 25)


@query(_years_sql(100, 30))
def year_windows_sliding(spark, folder):
    return _years(spark, folder, 100, 30)


@query(_years_sql(10, 25))
def year_windows_with_gaps(spark, folder):
    return _years(spark, folder, 10, 25)


def _diagnostics_sql(s: sampling.Sampling) -> str:
    strict = s.sampling_mode == "strict-balanced"
    manual = f"time_window_id IN ({', '.join(repr(w) for w in s.exclude_windows)})" if s.exclude_windows else "false"
    return f"""
    diagnostics AS (SELECT *, available_wordforms_before_sampling < {s.min_window_wordforms} AS time_window_is_low_n_warning,
      CASE WHEN {manual} THEN 'MANUALLY_EXCLUDED' WHEN total_token_count_represented_before_sampling < {s.min_window_tokens} THEN 'BELOW_MIN_TOKENS'
           WHEN {str(strict).lower()} AND available_wordforms_before_sampling < {s.min_window_wordforms} THEN 'BELOW_MIN_WORDFORMS' ELSE 'INCLUDED' END AS time_window_exclusion_reason
      FROM (SELECT time_window_start, time_window_end, time_window_id, count(DISTINCT wordform_id) AS available_wordforms_before_sampling, CAST(sum(token_count_in_window) AS BIGINT) AS total_token_count_represented_before_sampling
            FROM counted GROUP BY ALL))"""


_DIAGNOSTIC = ["time_window_start", "time_window_end", "time_window_id", "available_wordforms_before_sampling", "total_token_count_represented_before_sampling", "time_window_is_low_n_warning", "time_window_exclusion_reason"]


@query(f"WITH {_ROWS}, {_diagnostics_sql(_SETTINGS)} SELECT {', '.join(_DIAGNOSTIC)} FROM diagnostics")
def window_diagnostics(spark, folder):
    return sampling.window_diagnostics(_counts(spark, folder), _SETTINGS).select(*_DIAGNOSTIC)


@query(f"WITH {_ROWS}, {_diagnostics_sql(_STRICT)} SELECT time_window_id, time_window_exclusion_reason FROM diagnostics WHERE time_window_exclusion_reason <> 'INCLUDED'")
def excluded_windows(spark, folder):
    return sampling.excluded_windows(sampling.window_diagnostics(_counts(spark, folder), _STRICT)).select("time_window_id", "time_window_exclusion_reason")


def _sample_sql(s: sampling.Sampling) -> str:
    size = "(SELECT min(available_wordforms_before_sampling) FROM diagnostics WHERE time_window_exclusion_reason = 'INCLUDED')" if s.sampling_mode == "strict-balanced" else str(s.target_wordforms_per_window)
    return f"""WITH {_ROWS}, {_diagnostics_sql(s)}, sample AS (SELECT * FROM (
      SELECT time_window_id, wordform_id, token_count_in_window, CAST(row_number() OVER (PARTITION BY time_window_id ORDER BY token_count_in_window DESC, first_observed_year_in_window, token, vowel_seq) AS INTEGER) AS frequency_rank_in_window
      FROM counted WHERE time_window_id IN (SELECT time_window_id FROM diagnostics WHERE time_window_exclusion_reason = 'INCLUDED')) WHERE frequency_rank_in_window <= {size})"""


def _sample(spark, folder, s: sampling.Sampling) -> DataFrame:
    counts = checkpoint(_counts(spark, folder))  # sizes, ranks and windows all need them
    return sampling.select_wordforms(counts, sampling.window_diagnostics(counts, s), s)


_SAMPLED = ["time_window_id", "wordform_id", "token_count_in_window", "frequency_rank_in_window"]


@query(_sample_sql(_SETTINGS) + " SELECT * FROM sample")
def topk_per_window(spark, folder):
    return _sample(spark, folder, _SETTINGS).select(*_SAMPLED)


@query(_sample_sql(_STRICT) + " SELECT * FROM sample")
def strict_balanced_sample(spark, folder):
    return _sample(spark, folder, _STRICT).select(*_SAMPLED)


@query(_sample_sql(_SETTINGS) + " SELECT wid AS time_window_id, wf AS wordform_id, token_row_id FROM windowed WHERE (wid, wf) IN (SELECT (time_window_id, wordform_id) FROM sample)")
def selected_token_rows(spark, folder):
    rows = table(spark, folder, "token_rows")
    return sampling.selected_token_rows(rows, _sample(spark, folder, _SETTINGS), _SETTINGS).select("time_window_id", "wordform_id", "token_row_id")


# ---- pairs and baseline ----

_KEY = "run_name || '/' || time_window_id"
#: A word form counts once in a window, however often it was delivered.
_SAMPLED_ONCE = ["run_name", "time_window_id", "wordform_id", "token", "vowel_seq", "frequency_rank_in_window"]
_PAIRED_ONCE = ["run_name", "time_window_id", "time_window_start", "time_window_end", "wordform_id", "d2l_ur", "d2l_sr"]
_V = "list_filter(string_split(trim(vowel_seq), ' '), lambda v: v <> '')"
_HARMONIC_SQL = "('ㆍ', 'ㅏ', 'ㅗ', 'ㅡ', 'ㅓ', 'ㅜ')"
_UR = "[CASE WHEN i = 1 THEN v[i] ELSE CASE v[i] WHEN 'ㅏ' THEN 'A' WHEN 'ㅓ' THEN 'EO' WHEN 'ㅗ' THEN 'O' WHEN 'ㅜ' THEN 'U' WHEN 'ㆍ' THEN 'ARAE' WHEN 'ㅡ' THEN 'EU' ELSE v[i] END END for i in range(1, len(v) + 1)]"
_CONVERTED = f"""
    parsed AS (SELECT *, {_KEY} AS w, {_V} AS v FROM (SELECT DISTINCT {', '.join(_SAMPLED_ONCE)} FROM window_wordforms)),
    reasoned AS (SELECT *, list_sort(list_distinct(list_filter(v, lambda x: x NOT IN ('ㆍ', 'ㅏ', 'ㅗ', 'ㅡ', 'ㅓ', 'ㅜ', 'ㅣ')))) AS other FROM parsed),
    judged AS (SELECT *, CASE WHEN len(v) < 2 THEN 'BELOW_MIN_VOWELS' WHEN len(other) > 0 THEN 'NONCORE_VOWEL:' || array_to_string(other, ',') END AS reason FROM reasoned),
    eligible AS (SELECT w, wordform_id, token, v, array_to_string({_UR}, ' ') AS d2l_ur, array_to_string(v, ' ') AS d2l_sr,
                        CAST(len(list_filter(v[2:], lambda x: x IN {_HARMONIC_SQL})) AS INTEGER) AS d2l_num_targets, CAST(len(list_filter(v[2:], lambda x: x = 'ㅣ')) AS INTEGER) AS d2l_num_noninitial_i,
                        frequency_rank_in_window FROM judged WHERE reason IS NULL)"""


def _sampled(spark, folder) -> DataFrame:
    return table(spark, folder, "window_wordforms").select(*_SAMPLED_ONCE).distinct().withColumn("w", F.concat_ws("/", "run_name", "time_window_id"))


@query(f"""
    WITH {_CONVERTED} SELECT w, wordform_id, d2l_ur, d2l_sr, d2l_ur || chr(9) || d2l_sr AS d2l_pair_key, v[1] AS d2l_initial_vowel,
      CASE WHEN v[1] = 'ㅣ' THEN 'NEUTRAL' WHEN v[1] IN ('ㆍ', 'ㅏ', 'ㅗ') THEN '+RTR' ELSE '-RTR' END AS d2l_initial_rtr_class, CAST(len(v) AS INTEGER) AS d2l_num_segments, d2l_num_targets, d2l_num_noninitial_i,
      d2l_num_noninitial_i > 0 AS d2l_contains_noninitial_i, list_contains(v, 'ㆍ') AS d2l_contains_arae, d2l_num_targets > 0 AS d2l_has_prediction_target,
      CAST(count(*) OVER (PARTITION BY w, d2l_ur, d2l_sr) AS INTEGER) AS lexical_type_weight, count(*) OVER (PARTITION BY w, d2l_ur, d2l_sr) > 1 AS d2l_pair_is_shared_by_multiple_wordforms FROM eligible""")
def ur_sr_pairs(spark, folder):
    eligible, _ = pairs.convert(_sampled(spark, folder), "w")
    return eligible.select("w", "wordform_id", *(c for c in eligible.columns if c.startswith("d2l_") or c == "lexical_type_weight"))


@query(f"WITH {_CONVERTED} SELECT w, wordform_id, reason AS d2l_exclusion_reason FROM judged WHERE reason IS NOT NULL")
def pair_exclusions(spark, folder):
    return pairs.convert(_sampled(spark, folder), "w")[1].select("w", "wordform_id", "d2l_exclusion_reason")


@query(f"""
    WITH {_CONVERTED} SELECT w, d2l_ur, d2l_sr, CAST(count(*) AS INTEGER) AS lexical_type_weight,
      string_agg(wordform_id, ' ||| ' ORDER BY frequency_rank_in_window NULLS FIRST, wordform_id) AS represented_wordform_ids, min(d2l_num_targets) AS d2l_num_targets FROM eligible GROUP BY w, d2l_ur, d2l_sr""")
def weighted_pairs(spark, folder):
    found = pairs.weighted_pairs(pairs.convert(_sampled(spark, folder), "w")[0], "w")
    return found.select("w", "d2l_ur", "d2l_sr", "lexical_type_weight", "represented_wordform_ids", "d2l_num_targets")


@query(f"""
    WITH {_CONVERTED}, sums AS (SELECT w, count(*) AS sampled_wordforms_input, count(*) FILTER (reason IS NULL) AS d2l_eligible_lexical_wordforms, count(DISTINCT CASE WHEN reason IS NULL THEN array_to_string(v, ' ') END) AS unique_vowel_only_d2l_pairs,
      count(*) FILTER (reason IS NULL AND len(list_filter(v[2:], lambda x: x IN {_HARMONIC_SQL})) > 0) AS lexical_wordforms_with_at_least_one_target,
      count(*) FILTER (reason IS NULL AND list_contains(v[2:], 'ㅣ')) AS lexical_wordforms_with_noninitial_i, count(*) FILTER (reason IS NOT NULL) AS excluded_wordforms FROM judged GROUP BY w)
    SELECT *, d2l_eligible_lexical_wordforms - unique_vowel_only_d2l_pairs AS lexical_types_represented_by_weights_beyond_unique_pairs,
      round((d2l_eligible_lexical_wordforms - unique_vowel_only_d2l_pairs) / nullif(d2l_eligible_lexical_wordforms, 0)::DOUBLE, 9) AS fraction_lexical_types_collapsed_structurally,
      round(excluded_wordforms / nullif(sampled_wordforms_input, 0)::DOUBLE, 9) AS fraction_sample_excluded_from_core_inventory FROM sums""")
def pair_window_diagnostics(spark, folder):
    found = pairs.pair_diagnostics(_sampled(spark, folder), "w")
    return found.withColumns({c: F.round(c, 9) for c in found.columns if c.startswith("fraction_")})


_DETAIL = "w, d2l_sr, baseline_status, baseline_trigger, baseline_trigger_rtr, prediction_N, prediction_exceptions, wordform_exception"
_RTR_SQL = "CASE WHEN {0} = 'ㅣ' THEN '-RTR' WHEN {0} IN ('ㆍ', 'ㅏ', 'ㅗ') THEN '+RTR' WHEN {0} IN ('ㅡ', 'ㅓ', 'ㅜ') THEN '-RTR' END"
_SCORED = f"""
    split AS (SELECT *, {_KEY} AS w, coalesce(list_filter(string_split(trim(d2l_sr), ' '), lambda x: x <> ''), []) AS v FROM (SELECT DISTINCT {', '.join(_PAIRED_ONCE)} FROM d2l_wordforms)),
    aimed AS (SELECT *, list_sort(list_distinct(list_filter(v, lambda x: x NOT IN ('ㆍ', 'ㅏ', 'ㅗ', 'ㅡ', 'ㅓ', 'ㅜ', 'ㅣ')))) AS other, list_filter(v[2:], lambda x: x IN {_HARMONIC_SQL}) AS later, {_RTR_SQL.format('v[1]')} AS rtr FROM split),
    stated AS (SELECT *, CASE WHEN len(v) = 0 THEN 'EMPTY_SEQUENCE' WHEN len(other) > 0 THEN 'NONCORE_VOWEL:' || array_to_string(other, ',') WHEN v[1] = 'ㅣ' THEN 'INITIAL_I_UNSCORED'
                 WHEN len(later) = 0 THEN 'NO_LATER_HARMONIC_TARGET' ELSE 'SCORABLE' END AS baseline_status FROM aimed),
    scored AS (SELECT *, CASE WHEN baseline_status IN ('SCORABLE', 'NO_LATER_HARMONIC_TARGET') THEN v[1] END AS baseline_trigger, CASE WHEN baseline_status IN ('SCORABLE', 'NO_LATER_HARMONIC_TARGET') THEN rtr END AS baseline_trigger_rtr,
                 CASE WHEN baseline_status = 'SCORABLE' THEN CAST(len(later) AS INTEGER) ELSE 0 END AS "prediction_N",
                 CASE WHEN baseline_status = 'SCORABLE' THEN CAST(len(list_filter(later, lambda x: (x IN ('ㆍ', 'ㅏ', 'ㅗ')) <> (rtr = '+RTR'))) AS INTEGER) ELSE 0 END AS prediction_exceptions FROM stated),
    details AS (SELECT *, baseline_status = 'SCORABLE' AND prediction_exceptions > 0 AS wordform_exception FROM scored)"""


def _paired(spark, folder) -> DataFrame:
    return table(spark, folder, "d2l_wordforms").select(*_PAIRED_ONCE).distinct().withColumn("w", F.concat_ws("/", "run_name", "time_window_id"))


def _details(spark, folder) -> DataFrame:
    return pairs.baseline_details(_paired(spark, folder))


@query(f"WITH {_SCORED} SELECT {_DETAIL} FROM details")
def baseline_wordforms(spark, folder):
    return _details(spark, folder).select(*_DETAIL.split(", "))


def _rates_sql(p: str) -> str:
    n, e = f'"{p}_N"', f"{p}_exceptions"
    return f"""{n} - {e} AS {p}_correct, round({e} / nullif({n}, 0)::DOUBLE, 9) AS {p}_exception_rate, round(CASE WHEN {n} > 1 THEN {n} / ln({n}) END, 9) AS "{p}_theta_N",
      round(CASE WHEN {n} > 1 THEN 1 / ln({n}) END, 9) AS {p}_theta_rate, coalesce({n} > 1 AND {n} - {e} > 1 AND {n} - {e} >= {n} / 2 AND {e} <= CASE WHEN {n} > 1 THEN {n} / ln({n}) END, false) AS "{p}_TP_pass\""""


@query(f"""
    WITH {_SCORED}, sums AS (SELECT w, count(*) AS core_wordforms_input, count(*) FILTER (baseline_status = 'SCORABLE') AS scorable_wordforms, count(*) FILTER (baseline_status = 'INITIAL_I_UNSCORED') AS initial_i_unscored_wordforms,
      count(*) FILTER (baseline_status = 'NO_LATER_HARMONIC_TARGET') AS no_later_harmonic_target_wordforms, CAST(sum("prediction_N") AS BIGINT) AS "prediction_N", CAST(sum(prediction_exceptions) AS BIGINT) AS prediction_exceptions,
      count(*) FILTER (baseline_status = 'SCORABLE') AS "wordform_N", count(*) FILTER (wordform_exception) AS wordform_exceptions, min(time_window_start) AS time_window_start, min(time_window_end) AS time_window_end FROM details GROUP BY w)
    SELECT *, {_rates_sql('prediction')}, {_rates_sql('wordform')} FROM sums""")
def baseline_by_window(spark, folder):
    found = pairs.baseline_by_window(_details(spark, folder), "w")
    return found.withColumns({c: F.round(c, 9) for c in found.columns if c.endswith(("_rate", "_theta_N"))})


@query('SELECT n, round(CASE WHEN n > 1 THEN n / ln(n) END, 6) AS "theta_N", coalesce(n > 1 AND n - n // 5 > 1 AND n - n // 5 >= n / 2 AND n // 5 <= CASE WHEN n > 1 THEN n / ln(n) END, false) AS "TP_pass" FROM (SELECT DISTINCT token_count_in_window AS n FROM window_wordforms WHERE token_count_in_window > 0)')
def tolerance_threshold(spark, folder):
    n = F.col("n")
    counts = table(spark, folder, "window_wordforms").where("token_count_in_window > 0").select(F.col("token_count_in_window").alias("n")).distinct()
    return counts.select("n", F.round(pairs.theta(n), 6).alias("theta_N"), pairs.tolerance_pass(n, F.expr("n div 5")).alias("TP_pass"))


_MINUS = _SCORED.replace("WHEN v[1] = 'ㅣ' THEN 'INITIAL_I_UNSCORED'\n", "\n")


@query(f"WITH {_MINUS} SELECT {_DETAIL} FROM details")
def baseline_wordforms_minus_rtr(spark, folder):
    """The scores where an initial ㅣ counts as -RTR."""
    return pairs.baseline_details(_paired(spark, folder), initial_i="minus-rtr").select(*_DETAIL.split(", "))


# ---- learner ----


def _learned(spark, folder, mode: str = "progressive") -> DataFrame:
    rows = _paired(spark, folder).where("d2l_ur is not null and d2l_sr is not null")
    found = rows.groupBy("w", "d2l_ur", "d2l_sr").agg(F.count("*").cast("int").alias("lexical_type_weight"))
    return learning.learn(found, "w", mode)


@query()
def learner_results(spark, folder):
    return learning.results(_learned(spark, folder))


@query()
def learner_results_bidirectional(spark, folder):
    return learning.results(_learned(spark, folder, "bidirectional"))


@query()
def learner_trace(spark, folder):
    return learning.exploded(_learned(spark, folder), "trace", "w")


@query()
def learner_events(spark, folder):
    return learning.exploded(_learned(spark, folder), "events", "w")


@query()
def learner_pair_predictions(spark, folder):
    return learning.exploded(_learned(spark, folder), "predictions", "w")


@query()
def failure_context_summary(spark, folder):
    return learning.failure_contexts(learning.exploded(_learned(spark, folder), "events", "w"), "w")


@query()
def failure_target_summary(spark, folder):
    return learning.failure_targets(learning.exploded(_learned(spark, folder), "events", "w"), "w")


_RTR_OF = "CASE WHEN {0} IN ('ㆍ', 'ㅏ', 'ㅗ') THEN '+' WHEN {0} IN ('ㅡ', 'ㅓ', 'ㅜ', 'ㅣ') THEN '-' END"
_SURFACE_OF = "CASE WHEN {value} IS NULL THEN {symbol} WHEN {symbol} IN ('A', 'EO') THEN CASE {value} WHEN '+' THEN 'ㅏ' ELSE 'ㅓ' END WHEN {symbol} IN ('O', 'U') THEN CASE {value} WHEN '+' THEN 'ㅗ' ELSE 'ㅜ' END ELSE CASE {value} WHEN '+' THEN 'ㆍ' ELSE 'ㅡ' END END"


def _walk_sql(name: str, default: str) -> str:
    """A recursive CTE: the pairs read from left to right, each target predicted from the symbol before, as it was predicted."""
    symbol, context = "u[i]", "before"
    value = f"CASE WHEN list_contains(contexts, {context}) THEN {_RTR_OF.format(context)} ELSE {default} END"
    target = f"list_contains(targets, {symbol})"
    predicted = f"CASE WHEN {target} THEN {_SURFACE_OF.format(value=value, symbol=symbol)} ELSE {symbol} END"
    row = f"w, ur, sr, weight, u, s, targets, contexts, preset, i, {context} AS context, {target} AS is_target, {predicted} AS predicted, s[i] AS actual, solved AS resolved, ok AS before_right"
    return f"""
    {name} AS (
      SELECT {row} FROM (SELECT *, 1 AS i, '⋊' AS before, false AS solved, NULL::BOOLEAN AS ok FROM ruled)
      UNION ALL
      SELECT {row} FROM (SELECT * EXCLUDE (i, context, is_target, predicted, actual, resolved, before_right), i + 1 AS i, predicted AS before, is_target AS solved, predicted = actual AS ok FROM {name} WHERE i < len(u)))"""


#: The learner's first step: a rule without a tier, from left to right, with the default that follows from what the rule leaves open.
_FIRST_STEP = f"""
    pairs AS (SELECT {_KEY} AS w, d2l_ur AS ur, d2l_sr AS sr, count(*) AS weight, string_split(d2l_ur, ' ') AS u, string_split(d2l_sr, ' ') AS s FROM (SELECT DISTINCT {', '.join(_PAIRED_ONCE)} FROM d2l_wordforms) WHERE d2l_ur IS NOT NULL AND d2l_sr IS NOT NULL GROUP BY ALL),
    symbols AS (SELECT w, unnest(u) AS symbol, unnest(s) AS surface FROM pairs),
    changed AS (SELECT w, list(DISTINCT symbol) AS targets FROM symbols WHERE symbol <> surface GROUP BY w),
    next_to AS (SELECT w, list(DISTINCT before) AS contexts FROM (SELECT w, targets, unnest(u[1:len(u) - 1]) AS before, unnest(u[2:]) AS symbol FROM pairs JOIN changed USING (w)) WHERE list_contains(targets, symbol) GROUP BY w),
    ruled AS (SELECT pairs.*, targets, coalesce(contexts, []) AS contexts, NULL::VARCHAR AS preset FROM pairs JOIN changed USING (w) LEFT JOIN next_to USING (w)),
    {_walk_sql('undecided', 'NULL')},
    open_targets AS (SELECT w, actual, sum(weight) AS n FROM undecided WHERE list_contains(targets, predicted) GROUP BY w, actual),
    presets AS (SELECT w, {_RTR_OF.format('best')} AS preset FROM (SELECT w, first(actual ORDER BY n DESC, actual) AS best FROM open_targets GROUP BY w))"""
_FIRST_STEP += f""",
    {_walk_sql('decided', 'preset').replace('FROM ruled)', 'FROM (SELECT ruled.* REPLACE (presets.preset AS preset) FROM ruled LEFT JOIN presets USING (w)))')},
    predictions AS (SELECT * FROM decided WHERE is_target),
    misses AS (SELECT w, weight, context, CASE WHEN i = 1 THEN 'BOUNDARY' WHEN resolved THEN 'RESOLVED_TARGET_CONTEXT' ELSE 'ORIGINAL_SPECIFIED_CONTEXT' END AS source, list_contains(contexts, context) AS used, resolved AND NOT before_right AS again,
                      i = 2 AS protected, list_contains(contexts, context) AND i > 2 AND NOT list_contains(targets, context) AS eligible FROM predictions WHERE predicted <> actual),
    summed AS (SELECT w, 'harmony' AS branch, 0 AS attempt_depth, 'left_to_right' AS candidate_direction, true AS selected_candidate, context AS context_segment, source AS context_source, count(*) AS structural_failed_predictions,
                      CAST(sum(weight) AS BIGINT) AS weighted_failed_predictions, {', '.join(f"CAST(sum(CASE WHEN {c} THEN weight ELSE 0 END) AS BIGINT) AS {n}" for n, c in (('weighted_eligible_for_delset', 'eligible'), ('weighted_ineligible_for_delset', 'NOT eligible'), ('weighted_errors_after_prior_misprediction', 'again'), ('weighted_default_errors', 'NOT used'), ('weighted_protected_initial_context_errors', 'protected')))}
               FROM misses GROUP BY w, context, source)"""


@query(f"""
    WITH RECURSIVE {_FIRST_STEP}
    SELECT w, CAST(sum(weight) AS BIGINT) AS prediction_n, CAST(sum(CASE WHEN predicted = actual THEN weight ELSE 0 END) AS BIGINT) AS prediction_correct, round(CASE WHEN sum(weight) > 1 THEN sum(weight) / ln(sum(weight)) END, 6) AS theta_n,
      any_value(array_to_string(list_sort(targets), ' ')) AS target_segments, any_value(array_to_string(list_sort(contexts), ' ')) AS left_contexts, coalesce('RTR ' || any_value(preset), '') AS default_value FROM predictions GROUP BY w""")
def learner_first_step(spark, folder):
    """What the learner's first rule of each window predicts."""
    first = learning.exploded(_learned(spark, folder), "trace", "w").where("attempt_depth = 0")
    return first.select("w", F.col("selected_prediction_N").alias("prediction_n"), F.col("selected_prediction_correct").alias("prediction_correct"), F.round("theta_N", 6).alias("theta_n"), "target_segments", "left_contexts", F.col("default").alias("default_value"))


@query(f"""
    WITH RECURSIVE {_FIRST_STEP}
    SELECT *, round(weighted_failed_predictions / nullif(sum(weighted_failed_predictions) OVER (PARTITION BY w), 0)::DOUBLE, 9) AS share_of_weighted_failures,
      CAST(dense_rank() OVER (PARTITION BY w ORDER BY weighted_failed_predictions DESC) AS INTEGER) AS failure_rank_within_candidate FROM summed""")
def initial_harmony_failures(spark, folder):
    return learning.initial_harmony(failure_context_summary(spark, folder)).withColumn("share_of_weighted_failures", F.round("share_of_weighted_failures", 9))


@query(f"""
    WITH RECURSIVE {_FIRST_STEP}, placed AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY weighted_failed_predictions DESC, context_segment, context_source) AS place FROM summed)
    SELECT w, string_agg(context_segment || ':' || weighted_failed_predictions, '; ' ORDER BY place) AS initial_harmony_top_error_contexts FROM placed WHERE place <= 5 GROUP BY w""")
def top_failure_contexts(spark, folder):
    return learning.top_contexts(failure_context_summary(spark, folder), "w")


@query()
def merged_baseline(spark, folder):
    # the learner's result is a row for each window; written once, it is not made again for the check of its windows
    return learning.with_baseline(checkpoint(learning.results(_learned(spark, folder))), pairs.baseline_by_window(_details(spark, folder), "w"), "w")


# ---- files ----


def _there_and_back(spark, write, read) -> DataFrame:
    """What `read` finds of what `write` has left in the shared folder; the files go when it is there."""
    path = work_path(spark, "files")
    write(path)
    found = checkpoint(read(path))
    remove(spark, path)
    return found


@query("SELECT id, text, year, language, script, source, corpus FROM raw_documents WHERE text IS NOT NULL")
def documents_by_json_lines(spark, folder):
    """Documents written as JSON lines, which a second run leaves alone, and read with a count of what is no text."""
    docs = table(spark, folder, "raw_documents").select(*D.OPTIONAL)

    def write(path):
        files.write_documents(docs, path)
        files.write_documents(docs.limit(0), path)

    return _there_and_back(spark, write, lambda path: files.read_documents(spark, path, glob="*.json")[0].select(*D.OPTIONAL))


_CSV_COLUMNS = ["run_name", "time_window_id", "wordform_id", "token_count_in_window", "contains_idu_derived_observation"]


@query(f"SELECT {', '.join(_CSV_COLUMNS)} FROM window_wordforms")
def wordforms_by_csv(spark, folder):
    """Word forms written as CSV with a byte order mark and a fixed order of columns, and read by their header."""
    rows = table(spark, folder, "window_wordforms")
    typed = [F.col(c).cast(rows.schema[c].dataType).alias(c) for c in _CSV_COLUMNS]
    return _there_and_back(spark, lambda path: files.write_csv(rows, path, _CSV_COLUMNS), lambda path: files.read_csv(spark, path, _CSV_COLUMNS).select(*typed))


@query(f"WITH {_CONVERTED} SELECT replace(w, '/', '_') AS w, d2l_ur, d2l_sr, CAST(count(*) AS INTEGER) AS lexical_type_weight FROM eligible GROUP BY w, d2l_ur, d2l_sr")
def pairs_by_window_files(spark, folder):
    """Weighted pairs written as one headerless table for each window, and read with the window from the folder's name."""
    found = pairs.weighted_pairs(pairs.convert(_sampled(spark, folder), "w")[0], "w")
    back = _there_and_back(spark, lambda path: files.write_window_pairs(found, path, "w"), lambda path: files.read_window_pairs(spark, path))
    return back.withColumnRenamed("time_window_id", "w")


@query()
def identified_documents(spark, folder):
    """Stage 01 with a model that is trained here: a letter n-gram identifier, from a bounded sample of labelled documents."""
    docs = table(spark, folder, "raw_documents")
    texts, labels = language_id.labelled_sample(docs, table(spark, folder, "language_names"))
    model = spark.sparkContext.broadcast(language_id.Letters.train(texts, labels)) if texts else None
    load = partial(_value_of, model)
    known = [x for x in D.ALL_LABELS if x in labels]
    among = lambda wanted: language_id.identify(load, tuple(x for x in wanted if x in known)) if known else None
    return D.classify(D.profile(docs, among(D.ALL_LABELS)), among(D.RECORD_LABELS)).select("id", "language", "language_score", "category", "script")


def _value_of(shared):
    return shared.value


# ---- dictionary ----

#: A small dictionary of words that the given texts hold; the real one is a resource of the user.
_DICTIONARY = [{"sequence": 1, "idu_text": "不可不察", "hanja_text": "不可不察", "hangul_text": "불가불찰"}, {"sequence": 2, "idu_text": "不可", "hanja_text": "不可", "hangul_text": "불가"}, {"sequence": 3, "idu_text": "奏請", "hanja_text": "奏請", "hangul_text": "주청, 주쳥"}, {"sequence": 4, "idu_text": "啓曰", "hanja_text": "啓曰", "hangul_text": "계왈"}, {"sequence": 5, "idu_text": "從之以", "hanja_text": "從之以", "hangul_text": "종지이"}]


@query("""
    SELECT id, match_text, count(*) AS n_matches FROM (SELECT id, unnest(regexp_extract_all(text, '不可不察|從之以|不可|奏請|啓曰')) AS match_text FROM raw_documents) GROUP BY id, match_text""")
def idu_matches(spark, folder):
    matched = lexicon.match_column(lexicon.Lexicon.build(_DICTIONARY), spark)
    found = table(spark, folder, "raw_documents").select("id", F.explode(matched(F.col("text"))).alias("m"))
    return found.groupBy("id", F.col("m.match_text").alias("match_text")).agg(F.count("*").alias("n_matches"))


@query(r"""
    SELECT token, unnest(CASE WHEN raw = '' THEN [] WHEN len(p) > 1 THEN p ELSE [raw] END) AS reading FROM (
      SELECT token, trim(token_source) AS raw, list_filter(regexp_split_to_array(trim(token_source), '[\s,;/|]+'), lambda x: x <> '') AS p FROM (
        SELECT DISTINCT token, token || ', ' || coalesce(vowels, '') AS token_source FROM token_rows WHERE token IS NOT NULL AND regexp_matches(coalesce(vowels, ''), '^[ㅏ-ㅣㆍ,]*$')))""")
def idu_readings(spark, folder):
    rows = table(spark, folder, "token_rows").where(F.col("token").isNotNull() & F.coalesce("vowels", F.lit("")).rlike("^[ㅏ-ㅣㆍ,]*$"))
    made = rows.select("token", F.concat("token", F.lit(", "), F.coalesce("vowels", F.lit(""))).alias("h")).distinct()
    return made.select("token", F.explode(lexicon.reading_column(F.col("h"))).alias("r")).select("token", "r.reading")


@query()
def idu_readings_all_rows(spark, folder):
    """The readings of all tokens, whatever characters their vowels are written with."""
    rows = table(spark, folder, "token_rows").where(F.col("token").isNotNull())
    made = rows.select("token", F.concat("token", F.lit(", "), F.coalesce("vowels", F.lit(""))).alias("h")).distinct()
    return made.select("token", F.explode(lexicon.reading_column(F.col("h"))).alias("r")).select("token", "r.reading")


_READINGS = "('不可不察', '불가불찰'), ('不可', '불가'), ('奏請', '주청'), ('奏請', '주쳥'), ('啓曰', '계왈'), ('從之以', '종지이')"
_FOUND = f"{_processed_sql('raw_documents')}, found AS (SELECT id, unnest(regexp_extract_all(text, '不可不察|從之以|不可|奏請|啓曰')) AS match_text FROM kept)"


def _idu_settings(excluded: bool) -> tokens.Extraction:
    return tokens.Extraction(exclude_idu_derived_wordforms=excluded)


@query(f"WITH {_FOUND} SELECT id AS doc_id, match_text AS idu_match_text, reading AS token, count(*) AS n_rows FROM found JOIN (VALUES {_READINGS}) AS r(word, reading) ON match_text = word GROUP BY ALL")
def idu_token_rows(spark, folder):
    """The token rows of dictionary matches: all readings of each."""
    docs = D.classify(D.profile(table(spark, folder, "raw_documents")))
    rows = tokens.idu_rows(docs, lexicon.Lexicon.build(_DICTIONARY), _idu_settings(False))
    return rows.groupBy("doc_id", "idu_match_text", "token").agg(F.count("*").alias("n_rows"))


@query(f"""
    WITH {_FOUND}, {_tokens_sql('kept')}, {_EXTRACTED}
    SELECT (SELECT count(*) FROM kept WHERE text IS NOT NULL) AS documents_used, (SELECT count(*) FROM classed) AS hangul_rows, (SELECT count(*) FROM found) AS idu_matches, 0::BIGINT AS idu_rows_emitted,
      (SELECT count(*) FROM found JOIN (VALUES {_READINGS}) AS r(word, reading) ON match_text = word) AS idu_rows_suppressed""")
def extraction_counts(spark, folder):
    """What an extraction that excludes dictionary readings has seen, made and left out."""
    docs = D.classify(D.profile(table(spark, folder, "raw_documents")))
    found = tokens.counts(docs, _idu_settings(True), lexicon.Lexicon.build(_DICTIONARY))
    return found.select(*(F.col(c).cast("bigint").alias(c) for c in found.columns))


_HANJA_CHAR = "(" + " OR ".join(f"unicode(c) BETWEEN {a} AND {z}" for a, z in lexicon.HANJA) + ")"
_HANGUL_LETTER = "(" + " OR ".join(f"unicode(c) BETWEEN {a} AND {z}" for a, z in lexicon.HANGUL) + ")"


def _letters_of(c: str) -> str:
    return f"coalesce(len(list_filter(string_split(letters, ''), lambda c: c <> '' AND {c})), 0)"


#: The words of the small dictionary share no letter, so that none can stand where another does.
@query(f"""
    WITH {_normal_sql('raw_documents')},
    lettered AS (SELECT numbered.id, numbered.text AS given, {_replace('composed.text', _NO_LETTER)} AS letters FROM composed JOIN numbered USING (rid)),
    measured AS (SELECT *, length(coalesce(letters, '')) AS n, {_letters_of(_HANJA_CHAR)} AS hanja, {_letters_of(_HANGUL_LETTER)} AS hangul, regexp_extract_all(letters, '不可不察|啓曰|從之以') AS grammar, regexp_extract_all(letters, '奏請') AS nouns,
                        len(regexp_extract_all(letters || '。', '[爲去]乙[^丑卯巳未酉亥子寅辰午申戌]')) AS guards FROM lettered),
    scored AS (SELECT *, n > 0 AND hanja / n >= 0.88 AS open, len(grammar) AS hits, CASE WHEN n <= 100 THEN 0.0104 WHEN n <= 300 THEN 0.008622 ELSE 0.003813 END AS least, len(grammar) / greatest(hanja, 1)::DOUBLE AS score FROM measured)
    SELECT id, CASE WHEN NOT open OR given IS NULL OR given = '' THEN 'other' WHEN hits > 0 AND score >= least + CASE WHEN n <= 100 AND hits = 1 THEN 0.001 ELSE 0 END THEN 'kr' ELSE 'cc' END AS pred,
      CASE WHEN given IS NULL OR given = '' THEN 'no_text' WHEN n = 0 THEN 'no_valid_letters' WHEN NOT open THEN printf('low_hanja_%d(%.3f)', hanja, hanja / n) END AS reason,
      CASE WHEN open THEN CAST(hits AS INTEGER) ELSE 0 END AS raw, round(CAST(CASE WHEN n = 0 THEN 0 WHEN open THEN score ELSE hanja / n END AS DOUBLE), 9) AS ratio, CAST(CASE WHEN n = 0 THEN NULL WHEN open THEN least ELSE 0.88 END AS DOUBLE) AS threshold,
      CASE WHEN open THEN array_to_string(list_sort(list_distinct(grammar)), ' ') ELSE '' END AS matched, CASE WHEN open THEN array_to_string(nouns, ' ') ELSE '' END AS lex_only,
      CAST(length(coalesce(given, '')) AS INTEGER) AS orig_len, CAST(n AS INTEGER) AS norm_len, CAST(hanja AS INTEGER) AS hanja, CAST(hangul AS INTEGER) AS hangul, CASE WHEN open THEN CAST(hits + len(nouns) + guards AS INTEGER) ELSE 0 END AS n_spans FROM scored""")
def idu_classification(spark, folder):
    words = {d["idu_text"] for d in _DICTIONARY}
    classified = lexicon.classifier_column(lexicon.IduClassifier(words, ["爲", "去"], {"不可"}, {"奏請"}), spark)
    found = table(spark, folder, "raw_documents").select("id", classified(F.col("text")).alias("c"))
    listed = lambda c: F.array_join(c, " ")
    return found.select(
        "id", "c.pred", "c.reason", "c.raw", F.round("c.ratio", 9).alias("ratio"), F.round("c.threshold", 9).alias("threshold"), listed(F.array_sort("c.matched")).alias("matched"), listed("c.lex_only").alias("lex_only"),
        "c.orig_len", "c.norm_len", "c.hanja", "c.hangul", F.size("c.spans").alias("n_spans"),
    )
