"""The Idu dictionary: its entries, matches in texts, readings, and the classifier of Idu against Classical Chinese.

A dictionary is a resource of some thousand entries. It is built on the driver, refused beyond
MAX_ENTRIES, and sent to the tasks; texts are matched in Arrow batches.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MAX_ENTRIES = 500_000
# The mark of Idu particles, and the twelve branches that make it an ordinary word if one follows.
PARTICLE = "乙"
BRANCHES = "丑卯巳未酉亥子寅辰午申戌"
# Code point ranges of ideographs and of Hangul.
HANJA = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0x2CEB0, 0x2EBEF), (0x30000, 0x3134F), (0xF900, 0xFAFF))
HANGUL = ((0xAC00, 0xD7A3), (0x1100, 0x11FF), (0xA960, 0xA97F), (0xD7B0, 0xD7FF))
SEARCH_DIRECTORIES = (".", "resources", "idu/resources", "data", "data/idu")


def letters(text: object) -> str:
    """Compatibility form of a text, letters only."""
    return "".join(c for c in unicodedata.normalize("NFKC", str(text or "")) if unicodedata.category(c)[0] == "L")


def letters_with_places(text: str) -> tuple[str, list[int]]:
    """Letters of the compatibility form, and where they stand in it."""
    form = unicodedata.normalize("NFKC", text)
    places = [i for i, c in enumerate(form) if unicodedata.category(c)[0] == "L"]
    return "".join(form[i] for i in places), places


def read_resource(path: str | Path) -> list:
    """Values of a JSON list, of a JSON object's lists, or of JSON lines; blank lines are passed over."""
    path = Path(path)
    content = path.read_text(encoding="utf-8")
    if path.suffix.lower() == ".jsonl":
        return [json.loads(line) for line in content.splitlines() if line.strip()]
    found = json.loads(content)
    if isinstance(found, dict):
        return [x for v in found.values() for x in (v if isinstance(v, list) else [v])]
    return found


def find_resource(name: str, directories: tuple[str, ...] = SEARCH_DIRECTORIES) -> Path | None:
    """The first file of that name in the directories."""
    return next((p for d in directories if (p := Path(d) / name).exists()), None)


def _values(items: list) -> set[str]:
    return {n for x in items if (n := letters(x.get("text", "") if isinstance(x, dict) else x))}


@dataclass(frozen=True)
class Entry:
    sequence: str | None
    idu_text: str
    hanja_text: str
    hangul_text: str
    is_general_exclusion: bool
    is_noun_exclusion: bool


@dataclass
class Lexicon:
    """Entries by their normal text; empty if there is no dictionary, which is no error."""

    entries: dict[str, list[Entry]] = field(default_factory=dict)

    @classmethod
    def build(cls, items: list[dict], general: list = (), nouns: list = (), emit_general: bool = False, emit_nouns: bool = True) -> Lexicon:
        if len(items) > MAX_ENTRIES:
            raise ValueError(f"a dictionary of {len(items)} entries is too large to send to every task")
        excluded, noun = _values(list(general)), _values(list(nouns))
        entries: dict[str, list[Entry]] = {}
        for item in items:
            key, reading = letters(item.get("idu_text")), str(item.get("hangul_text") or "").strip()
            if not key or not reading or (key in excluded and not emit_general) or (key in noun and not emit_nouns):
                continue
            sequence = item.get("sequence")
            e = Entry(None if sequence is None else str(sequence), key, str(item.get("hanja_text") or "").strip(), reading, key in excluded, key in noun)
            if e not in entries.setdefault(key, []):
                entries[key].append(e)
        return cls(entries)

    @classmethod
    def load(cls, dictionary: str | Path | None, general: str | Path | None = None, nouns: str | Path | None = None, **options) -> Lexicon:
        if dictionary is None or not Path(dictionary).exists():
            return cls()
        read = lambda p: read_resource(p) if p and Path(p).exists() else []
        return cls.build(read_resource(dictionary), read(general), read(nouns), **options)

    def automaton(self):
        """Of all entries; None if there are none. It reads a text once, however many entries there are."""
        if not self.entries:
            return None
        import ahocorasick

        out = ahocorasick.Automaton()
        for word in self.entries:
            out.add_word(word, len(word))
        out.make_automaton()
        return out

    def matches(self, text: str, automaton=None) -> list[tuple[int, int, str]]:
        """(start, end, matched) of leftmost longest matches that don't overlap; places are those of the given text.

        A character whose compatibility form has several letters is one place: after a match, all
        of its letters count as used.
        """
        automaton = automaton or self.automaton()
        if automaton is None or not text:
            return []
        forms = [unicodedata.normalize("NFKC", c) for c in text]
        owner = [i for i, f in enumerate(forms) for _ in f]
        whole = "".join(forms)
        longest: dict[int, int] = {}
        for last, n in automaton.iter(whole):
            longest[last + 1 - n] = max(n, longest.get(last + 1 - n, 0))
        out, at, end = [], 0, 0
        for a in sorted(longest):
            if a >= at and owner[a] >= end:
                at = a + longest[a]
                end = owner[at - 1] + 1
                out.append((owner[a], end, whole[a:at]))
        return out


MATCH = "array<struct<start:int,end:int,match_text:string,entries:array<struct<sequence:string,idu_text:string,hanja_text:string,hangul_text:string,is_general_exclusion:boolean,is_noun_exclusion:boolean>>>>"


def match_column(lexicon: Lexicon, spark: SparkSession) -> Callable[[Column], Column]:
    """A column function: the matches of a text with their entries; empty for null."""
    shared = spark.sparkContext.broadcast(lexicon)

    @F.pandas_udf(MATCH)
    def matched(text: pd.Series) -> pd.Series:
        own = shared.value
        automaton = own.automaton()
        rows = {k: [vars(e) for e in entries] for k, entries in own.entries.items()}
        return text.map(lambda t: [{"start": a, "end": b, "match_text": m, "entries": rows[m]} for a, b, m in own.matches(t or "", automaton)])

    return matched


def reading_column(hangul: Column) -> Column:
    """array of struct(reading, note): readings that separators part; a long one without them may be several."""
    raw = F.trim(F.coalesce(hangul, F.lit("")))
    pieces = F.filter(F.split(raw, r"[\s,;/|]+"), lambda p: p != "")
    note = F.when(F.char_length(raw) >= 7, "dictionary_hangul_text_single_or_possible_concatenated_variants").otherwise("dictionary_hangul_text_single")
    one = F.array(F.struct(raw.alias("reading"), note.alias("note")))
    many = F.transform(pieces, lambda p: F.struct(p.alias("reading"), F.lit("dictionary_hangul_text_split_on_explicit_separator").alias("note")))
    return F.when(raw == "", F.slice(one, 1, 0)).when(F.size(pieces) > 1, many).otherwise(one)


@dataclass(frozen=True)
class ClassifierSettings:
    """The gate, the score and its thresholds by length."""

    hanja_ratio_min: float = 0.88
    token_len_min: int = 2
    thresholds: tuple[tuple[float, float], ...] = ((100, 0.0104), (300, 0.008622), (float("inf"), 0.003813))
    use_length_buckets: bool = True
    count_by_frequency: bool = True
    score_denominator: str = "hanja"
    enforce_grammar_hits: bool = True
    min_morph_hits_short: int = 1
    short_length: int = 100
    short_single_morph_delta: float = 0.001

    def __post_init__(self):
        if self.score_denominator not in ("hanja", "total"):
            raise ValueError("score_denominator is hanja or total")

    def threshold(self, n: int) -> float:
        length = n if self.use_length_buckets else 300
        return next(t for most, t in self.thresholds if length <= most)


RESULT = (
    "pred string, reason string, raw int, weighted int, ratio double, threshold double, matched array<string>, lex_only array<string>, excluded array<string>, "
    "orig_len int, norm_len int, hanja int, hangul int, spans array<struct<start:int,end:int,start_norm:int,end_norm:int,text:string,source:string>>"
)


class IduClassifier:
    """Tells Idu (kr) from Classical Chinese (cc) by grammatical words; other where a text is not nearly all Hanja.

    `threshold` in a result is that of the length, without the addition for a single word; places
    are those of the text's compatibility form.
    """

    def __init__(self, dictionary: set[str], heads: list[str], exclusions: set[str] = frozenset(), nouns: set[str] = frozenset(), settings: ClassifierSettings = ClassifierSettings()):
        norm = lambda words: {n for w in words if len(n := letters(w)) >= settings.token_len_min}
        self.settings, self.exclusions, self.nouns = settings, {letters(w) for w in exclusions}, {letters(w) for w in nouns}
        self.dictionary = norm(dictionary) - self.exclusions
        # without heads the guard is any particle that no branch follows
        self.guard = re.compile(f"(?:{'|'.join(map(re.escape, heads))}){PARTICLE}(?![{BRANCHES}])")
        self._automaton = None

    @classmethod
    def load(cls, dictionary: str | Path, heads: str | Path, exclusions: str | Path, nouns: str | Path, settings: ClassifierSettings = ClassifierSettings()) -> IduClassifier:
        """From resource files. All must be there and hold something, and be lists; else FileNotFoundError or ValueError."""
        read = {}
        for name, path in {"dictionary": dictionary, "heads": heads, "exclusions": exclusions, "nouns": nouns}.items():
            if not Path(path).exists() or not Path(path).stat().st_size:
                raise FileNotFoundError(f"{path} is missing or empty")
            if Path(path).suffix.lower() == ".json" and not isinstance(json.loads(Path(path).read_text(encoding="utf-8")), list):
                raise ValueError(f"{path} is not a list")
            read[name] = read_resource(path)
        text = lambda x: x.get("idu_text", x.get("text", "")) if isinstance(x, dict) else x
        return cls({text(x) for x in read["dictionary"]}, [h for h in read["heads"] if h], {text(x) for x in read["exclusions"]}, {text(x) for x in read["nouns"]}, settings)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def _found(self, s: str) -> list[tuple[int, int, str, str]]:
        """Spans of guards and words; guards first, then the longer, then the earlier takes its place."""
        if self._automaton is None and self.dictionary:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for word in self.dictionary:
                self._automaton.add_word(word, word)
            self._automaton.make_automaton()
        spans = [(m.start(), m.end(), m.group(), "idu_head_guard") for m in self.guard.finditer(s)]
        if self._automaton is not None:
            spans += [(end + 1 - len(w), end + 1, w, "dictionary") for end, w in self._automaton.iter(s)]
        taken, out = bytearray(len(s)), []
        for a, b, w, source in sorted(spans, key=lambda x: (x[3] == "dictionary", x[0] - x[1], x[0])):
            if not any(taken[a:b]):
                taken[a:b] = b"\1" * (b - a)
                out.append((a, b, w, source))
        return out

    def classify(self, text: str | None) -> dict:
        result = {"pred": "other", "reason": None, "raw": 0, "weighted": 0, "ratio": 0.0, "threshold": None, "matched": [], "lex_only": [], "excluded": [], "orig_len": len(text or ""), "norm_len": 0, "hanja": 0, "hangul": 0, "spans": []}
        if not text:
            return result | {"reason": "no_text"}
        s, places = letters_with_places(text)
        if not s:
            return result | {"reason": "no_valid_letters"}
        count = lambda ranges: sum(any(a <= ord(c) <= b for a, b in ranges) for c in s)
        n, hanja, settings = len(s), count(HANJA), self.settings
        result |= {"norm_len": n, "hanja": hanja, "hangul": count(HANGUL)}
        if hanja / n < settings.hanja_ratio_min:
            return result | {"reason": f"low_hanja_{hanja}({hanja / n:.3f})", "ratio": hanja / n, "threshold": settings.hanja_ratio_min}
        spans = self._found(s)
        real = [w for _, b, w, source in spans if not (source == "dictionary" and w.endswith(PARTICLE) and s[b : b + 1] and s[b] in BRANCHES)]
        words = [w for w in real if w in self.dictionary]
        grammar = [w for w in words if w not in self.nouns]
        distinct = list(dict.fromkeys(grammar))
        weighted = len(grammar) if settings.count_by_frequency else len(distinct)
        score = weighted / max(1, hanja if settings.score_denominator == "hanja" else n)
        threshold = settings.threshold(n)
        needed = threshold
        if (settings.enforce_grammar_hits or words) and not grammar:
            score = 0.0
        if n <= settings.short_length:
            # occurrences count here, not distinct words
            if len(grammar) < settings.min_morph_hits_short:
                score = 0.0
            elif len(grammar) == 1:
                needed += settings.short_single_morph_delta
        return result | {
            "pred": "kr" if score >= needed else "cc", "raw": len(grammar), "weighted": weighted, "ratio": score, "threshold": threshold, "matched": distinct, "lex_only": [w for w in words if w in self.nouns],
            "spans": [{"start": places[a], "end": places[b - 1] + 1, "start_norm": a, "end_norm": b, "text": w, "source": source} for a, b, w, source in spans],
        }


def classifier_column(classifier: IduClassifier, spark: SparkSession) -> Callable[[Column], Column]:
    """A column function: the classifier's result as a struct."""
    shared = spark.sparkContext.broadcast(classifier)

    @F.pandas_udf(RESULT)
    def classified(text: pd.Series) -> pd.DataFrame:
        own = shared.value
        return pd.DataFrame([own.classify(t) for t in text], columns=[c.split(" ")[0] for c in re.split(r", (?![^<]*>)", RESULT)])

    return classified
