"""The vowel inventory and the script classes: fixed values of the analysis."""

# The vowel letters, in order of their code points.
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
ARAEA, ARAEA_I = "ㆍ", "ㆎ"
FIRST_SYLLABLE, LAST_SYLLABLE = 0xAC00, 0xD7A3
#: Conjoining vowels U+1161 to U+1175 stand in the order of VOWELS.
FIRST_JAMO_VOWEL = 0x1161
JAMO_ARAEA, JAMO_ARAEA_I = 0x119E, 0x11A1
# Characters that are drawn like a vowel letter, beside those of other forms of the letter itself.
VOWEL_LOOKALIKES = {
    "ㅏ": "卜⊢⊦ト⨽",
    "ㅓ": "⊣丩",
    "ㅗ": "⊥丄上ꓕ⟂",
    "ㅜ": "⊤丅下TΤТꓔ",
    "ㅡ": "一—–‒―‐‑−ー─-_",
    "ㅣ": "丨│|∣lI⏐ǀІ┃",
    "ㆍ": "·・•‧∙⋅·᛫",
    ",": "‚،、̦⸴ꓹ",
}

# Harmony classes of the seven-vowel core and of the expanded inventory.
PLUS, MINUS, NEUTRAL, OTHER = "+RTR", "-RTR", "NEUTRAL", "OTHER"
CORE = {"ㆍ": PLUS, "ㅏ": PLUS, "ㅗ": PLUS, "ㅡ": MINUS, "ㅓ": MINUS, "ㅜ": MINUS, "ㅣ": NEUTRAL}
EXPANDED = CORE | dict.fromkeys("ㅐㅑㅒㅘㅙㅚㅛㆎ", PLUS) | dict.fromkeys("ㅔㅕㅖㅝㅞㅟㅠㅢ", MINUS)
INVENTORIES = {"core": CORE, "expanded": EXPANDED}

# Abstract symbols of vowels whose harmony is to be predicted, and the two letters that each can be.
TARGET_OF = {"ㅏ": "A", "ㅓ": "EO", "ㅗ": "O", "ㅜ": "U", "ㆍ": "ARAE", "ㅡ": "EU"}
TARGET_PAIRS = {"A": ("ㅏ", "ㅓ"), "EO": ("ㅏ", "ㅓ"), "O": ("ㅗ", "ㅜ"), "U": ("ㅗ", "ㅜ"), "ARAE": ("ㆍ", "ㅡ"), "EU": ("ㆍ", "ㅡ")}

# Features of the core segments.
SEGMENTS = {
    "ㅏ": {"syl": "+", "round": "-", "low_series": "+", "central_series": "-", "front": "-", "RTR": "+"},
    "ㅓ": {"syl": "+", "round": "-", "low_series": "+", "central_series": "-", "front": "-", "RTR": "-"},
    "ㅗ": {"syl": "+", "round": "+", "low_series": "-", "central_series": "-", "front": "-", "RTR": "+"},
    "ㅜ": {"syl": "+", "round": "+", "low_series": "-", "central_series": "-", "front": "-", "RTR": "-"},
    "ㆍ": {"syl": "+", "round": "-", "low_series": "-", "central_series": "+", "front": "-", "RTR": "+"},
    "ㅡ": {"syl": "+", "round": "-", "low_series": "-", "central_series": "+", "front": "-", "RTR": "-"},
    "ㅣ": {"syl": "+", "round": "-", "low_series": "-", "central_series": "-", "front": "+", "RTR": "-"},
}

# Code points of the private areas and jamo blocks that old Hangul is written with.
_OLD_HANGUL = r"\x{1100}-\x{11FF}\x{A960}-\x{A97F}\x{D7B0}-\x{D7FF}\x{302E}-\x{302F}\x{E0BC}-\x{EFFF}\x{F100}-\x{F66E}\x{F784}-\x{F800}\x{F806}-\x{F864}\x{F86A}-\x{F8F7}\x{E001}-\x{E0A0}"
SCRIPT_CLASSES = {
    "kor": rf"[\p{{IsHangul}}\x{{3130}}-\x{{318F}}{_OLD_HANGUL}]",
    "oko": rf"[{_OLD_HANGUL}]",
    "jpn": r"[\p{IsHiragana}\p{IsKatakana}]",
    "han": r"\p{IsHan}",
    "lat": r"\p{IsLatin}",
}
#: What script ratios leave out: punctuation, separators, space, digits and the two forms of arae-a.
NOT_COUNTED = r"(?U)[\p{P}\p{Z}\s\d\x{119E}\x{318D}]+"
