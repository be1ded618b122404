"""Text operators on small cases and edge cases."""

import sys

import numpy as np
import pytest

from hanstrata.llm import codepoints as cp
from hanstrata.llm import language, leakage, mixing, residue
from hanstrata.llm import visual_form as vf

LONG = "아주 긴 글이다. " * 20_000


@pytest.fixture(scope="module")
def table(spark):
    return vf.text_table(spark)


def test_codepoints_round_trip():
    texts = ["", "a", "한글𠀀", "", "é"]
    points, offsets = cp.explode(texts)
    assert cp.rebuild(points, offsets) == texts


@pytest.mark.parametrize(("a", "b"), [
    ("ＡＢＣ １２３", "ABC 123"), ("ｶﾞｽ", "ガス"), ("été", "été"), ("한글", "한글"), ("한​글", "한글"),
    ("a b", "a b"), ("a　b", "a b"), ("раура", "paypa"), ("Αlpha", "Alpha"), ("⽊⾺", "木馬"), ("金︀", "金"), ("ạ́", "ạ́"), ("x\r\ny", "x\ny"),
])
def test_same_look_same_form(table, a, b):
    assert vf.canonical([a], table) == vf.canonical([b], table)


@pytest.mark.parametrize(("a", "b"), [("A", "a"), ("é", "e"), ("1", "l"), ("a b", "ab"), ("a\nb", "a b"), ("a.", "a"), ("口", "ロ"), ("O", "0")])
def test_other_look_other_form(table, a, b):
    assert vf.canonical([a], table) != vf.canonical([b], table)


@pytest.mark.parametrize("v", ["ￜ,​ￌ,ᆞ", "ᅵ,ᅩ,ᆞ", "丨﹐⊥，·", "ㅣ ,ㅗ,﻿ㆍ"])
def test_vowels(v):
    assert vf.canonical([v], vf.vowel_table(), compose=False) == ["ㅣ,ㅗ,ㆍ"]


def test_vowels_in_the_core_agree(spark):
    from pyspark.sql import functions as F

    from hanstrata.functions import harmony

    own = set("ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣㆍㆎ,")
    alone = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x2FA20), *range(0xE0000, 0xE1000))]
    forms = dict(zip(alone, vf.canonical(alone, vf.vowel_table(), compose=False), strict=True))
    forms = {c: f for c, f in forms.items() if f in own or not f}
    df = spark.createDataFrame([(c, f"ㅗ,{c}", f"ㅗ,{f}") for c, f in forms.items()] + [("x", "x,ㅗ", "x,ㅗ"), ("", "", "")], "c string, v string, form string")
    assert len(forms) > 500 and df.where(harmony.consistent_vowels(F.col("v")) != F.col("form")).collect() == []


def test_all_rows_get_classes_flags_and_readings(spark, tmp_path):
    from hanstrata.plans import registry

    rows = [(1, "가", "ㅏ,ㅗ"), (2, "나", "卜﹐ᅩ"), (3, "다", "ￜ,\u200bᆡ"), (4, "라", None), (5, "마", "ㅡ,ㆎ"), (6, "바", "ㅏ,x")]
    spark.createDataFrame(rows, "token_row_id bigint, token string, vowels string").write.parquet(str(tmp_path / "token_rows.parquet"))
    made = {name: registry.QUERIES[f"{name}_all_rows"](spark, str(tmp_path)).collect() for name in ("vowel_classes", "arae_flags", "idu_readings")}
    assert {r["token_row_id"]: (r["vowel_classes"], r["harmony_status"], r["num_vowels"]) for r in made["vowel_classes"]} == {
        1: ("+RTR,+RTR", "harmonic", 2), 2: ("+RTR,+RTR", "harmonic", 2), 3: ("NEUTRAL,+RTR", "harmonic_with_neutral", 2), 5: ("-RTR,+RTR", "disharmonic", 2), 6: ("+RTR,OTHER", "unclassifiable_due_to_other", 2),
    }
    assert {r["token_row_id"]: (r["has_a"], r["has_initial_a"], r["has_eu"]) for r in made["arae_flags"]} == {1: (1, 1, 0), 2: (1, 1, 0), 3: (0, 0, 0), 5: (0, 0, 1), 6: (1, 1, 0)}
    assert {r["token"] for r in made["idu_readings"]} == {r[1] for r in rows} and ("마", "ㆎ") in {tuple(r) for r in made["idu_readings"]}


def test_lookalike_pairs(spark):
    rows = [("b", "ABC"), ("a", "ＡBC"), ("a", "ＡBC"), ("c", "ABC"), ("d", None), ("e", ""), ("f", " "), ("g", "　"), (None, "ABC"), ("h", LONG), ("i", LONG.replace(" ", " "))]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "id string, text string, form string, key string")
    assert sorted(map(tuple, vf.lookalike_pairs(df, "id", "text").collect())) == [("a", "b"), ("a", "c"), ("h", "i")]
    assert vf.lookalike_pairs(df.limit(0), "id", "text").count() == 0
    v = spark.createDataFrame([(1, "ㅏ,ㅗ"), (2, "ᅡ,ㅗ"), (2, "ᅡ,ㅗ"), (3, None), (4, "")], "k bigint, v string")
    assert [tuple(r) for r in vf.inconsistent_vowels(v, "k", "v").collect()] == [(2, "ㅏ,ㅗ")]


def test_pairs_of_a_class_with_most_rows(spark, monkeypatch):
    monkeypatch.setattr(vf, "BLOCK", 16)
    forms = ["ABC", "ＡBC", "AＢC", "ABＣ"]
    rows = [(f"k{i:04d}", forms[i % 4]) for i in range(120)] + [("k0000", "ＡBC"), ("z", "other"), ("y", "ｏther"), ("x", "x"), ("w", "x")]
    got = sorted(map(tuple, vf.lookalike_pairs(spark.createDataFrame(rows, "id string, text string").repartition(4), "id", "text").collect()))
    want = set()
    for a, t in rows:
        for b, u in rows:
            if a < b and t != u and ({t, u} <= set(forms) or {t, u} == {"other", "ｏther"}):
                want.add((a, b))
    assert got == sorted(want)


PASSAGE = "흔한 두실의 전늠다는 깊은 본긴득을 이미 헐었다. 11월 4일에 넓은 연못이 애훅져로 토맹을 모이니 기루히를 헐었다. 낡은 픙힘브가 플믕으로 들어가 종이를 베꼈다. 할작농이 농부를 모이니 마을의 비단에 끝났다. 본령능과 쌀이 졸등까지 급히 끝났다."
OTHER = "A clerk of Broupam was sent away after a gate of Mifeld counted a widow of Teareth near the old temple, and the narrow hill was not yet finished so that the late clerk hid a silk of Brafadeck."


def test_leaked_items(spark):
    docs = [
        (1, "앞말. " + PASSAGE + " 뒷말."), (2, PASSAGE[: len(PASSAGE) * 6 // 10]), (3, PASSAGE[:20]), (4, None), (5, ""), (6, "전혀 다른 글이 여기에 있다. " * 30),
        (7, PASSAGE.replace("연못이", "우물이").replace(" ", "\n")), (8, OTHER.upper()), (9, LONG + PASSAGE), (1, "앞말. " + PASSAGE + " 뒷말."),
    ]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id bigint, text string, item_id bigint").repartition(3)
    items = spark.createDataFrame([(10, PASSAGE), (11, OTHER), (12, None), (13, ""), (10, PASSAGE)], "item_id bigint, passage string")
    got = sorted((r["doc_id"], r["item_id"]) for r in leakage.leaked_items(df, "doc_id", "text", items, "item_id", "passage").collect())
    assert got == [(1, 10), (2, 10), (7, 10), (8, 11), (9, 10)]
    assert leakage.leaked_items(df.limit(0), "doc_id", "text", items, "item_id", "passage").count() == 0
    assert leakage.leaked_items(df, "doc_id", "text", items.limit(0), "item_id", "passage").count() == 0


def test_items_in_blocks_and_their_answers(spark, monkeypatch):
    docs = spark.createDataFrame([(1, PASSAGE + " 정답은 연못이다."), (2, OTHER)], "doc_id bigint, text string")
    items = spark.createDataFrame([("a", PASSAGE, "연못"), ("b", OTHER, "a bridge"), ("c", "짧은 글", None)], "item_id string, passage string, answer string")
    monkeypatch.setattr(leakage, "ITEM_CHARACTERS", 200)
    got = leakage.leaked_items(docs, "doc_id", "text", items, "item_id", "passage", "answer").collect()
    assert sorted((r["doc_id"], r["item_id"], r["answer_found"]) for r in got) == [(1, "a", True), (2, "b", False)]


def test_retrieval_recall_against_brute_force(spark, table):
    rng = np.random.default_rng(5)
    syllables = [chr(0xAC00 + int(i)) for i in rng.integers(0, 11172, 800)]
    passages = ["".join(rng.choice(syllables, int(n))) for n in rng.integers(60, 200, 80)]
    texts, truth = [], set()
    for d in range(200):
        t = "".join(rng.choice(syllables, 150))
        if d % 2:
            i = int(rng.integers(80))
            n = int(len(passages[i]) * 0.65)
            t = t[:70] + passages[i][:n] + t[70:]
            truth.add((d, i))
        texts.append(t)
    p, o = leakage.letters(passages, table)
    v = leakage.Vocabulary(leakage.grams(p, o)[0])
    idf = np.ones(len(v.hashes))
    row, column, weight = leakage.tfidf_rows(p, o, v, idf)
    a = np.zeros((80, leakage.COLUMNS), np.float32)
    np.add.at(a, (row, column), weight)
    basis = np.linalg.svd(a, full_matrices=False)[2].T.astype(np.float32)
    items = leakage.Items(np.arange(80), p, o, v, idf, 1.0, basis)
    found = {tuple(x) for x in leakage.candidates(*leakage.letters(texts, table), items)[0].tolist()}
    assert len(truth & found) >= 0.9 * len(truth)


def ideographs(rng, n: int) -> str:
    return "".join(map(chr, rng.integers(0x4E00, 0x9FA0, n)))


def replaced(text: str, kept: int, other: int, rng, latin: bool = False) -> str:
    """text with `other` letters replaced after each `kept`, from a place of its own."""
    foreign = (lambda n: "".join(rng.choice(list("bcdfg"), n))) if latin else (lambda n: ideographs(rng, n))
    a = int(rng.integers(kept + other))
    return "".join(c if (i + a) % (kept + other) < kept else foreign(1) for i, c in enumerate(text))


def found_pairs(spark, docs: list[str], passages: list[str], **more) -> set[tuple[int, int]]:
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string").repartition(4)
    items = spark.createDataFrame(list(enumerate(passages)), "item_id int, passage string")
    return {(r["doc_id"], r["item_id"]) for r in leakage.leaked_items(df, "doc_id", "text", items, "item_id", "passage", **more).collect()}


def test_long_item_in_a_third_of_many_documents(spark):
    rng = np.random.default_rng(11)
    passage = ideographs(rng, 1200)
    docs = [ideographs(rng, 60) + replaced(passage, 24, 4, rng) if d % 3 == 0 else ideographs(rng, 300) for d in range(600)]
    assert found_pairs(spark, docs, [passage, OTHER]) == {(d, 0) for d in range(0, 600, 3)}


def test_passages_held_in_scattered_pieces(spark):
    rng = np.random.default_rng(12)
    long, short, fine, latin = ideographs(rng, 400), ideographs(rng, 90), ideographs(rng, 150), "".join(rng.choice(list("aehiklmnoprstuwy"), 340))
    apart = lambda text, pieces, n: "".join(text[a : a + n] + ideographs(rng, 200) for a in range(0, pieces * n, n))
    docs = [apart(long, 6, 35), apart(short, 3, 30), replaced(fine, 7, 8, rng), replaced(latin, 10, 24, rng, latin=True), apart(long, 5, 35)]
    many = [ideographs(rng, 90) for _ in range(30)]
    # also with a basis that holds a part of the passages
    for rank in (leakage.RANK, 4):
        assert found_pairs(spark, docs, [long, short, fine, latin, *many], rank=rank) == {(0, 0), (1, 1), (2, 2), (3, 3)}


def test_recall_with_five_times_as_many_passages_as_the_rank(spark):
    rng = np.random.default_rng(13)
    passages = [ideographs(rng, int(n)) for n in rng.integers(60, 120, 200)]
    docs, truth = [], set()
    for d in range(120):
        item = int(rng.integers(200))
        docs.append(ideographs(rng, 80) + replaced(passages[item], 20, 3, rng)[: int(len(passages[item]) * 0.75)] + ideographs(rng, 80) if d % 2 else ideographs(rng, 240))
        truth |= {(d, item)} if d % 2 else set()
    found = found_pairs(spark, docs, passages, rank=40)
    assert len(found & truth) >= 0.9 * len(truth) and found <= truth


def test_one_letter_repeated_for_ever(spark):
    rng = np.random.default_rng(14)
    passage = ideographs(rng, 40) + "ㅋ" * 60 + ideographs(rng, 40)
    docs = ["ㅋ" * 300_000 + passage + "ㅋ" * 300_000, "ㅋ" * 400_000, passage[:30] + "ㅋ" * 200_000 + passage[-30:], passage[:30] + "ㅋ" * 200_000]
    assert found_pairs(spark, docs, [passage]) == {(0, 0), (2, 0), (3, 0)}


def items_of(passages: list[str], table) -> leakage.Items:
    p, o = leakage.letters(passages, table)
    v = leakage.Vocabulary(leakage.grams(p, o)[0])
    row, column, weight = leakage.tfidf_rows(p, o, v, np.ones(len(v.hashes)))
    a = np.zeros((len(passages), leakage.COLUMNS), np.float32)
    np.add.at(a, (row, column), weight)
    return leakage.Items(np.arange(len(passages)), p, o, v, np.ones(len(v.hashes)), 1.0, np.linalg.svd(a, full_matrices=False)[2].T.astype(np.float32))


def held_by_force(text: str, passage: str) -> float:
    """Share of an ideographic or Latin passage that a text holds, from all pairs of their letters."""
    latin = passage[0] < "\u0250"
    least, gap, shortest = leakage.MIN_STRETCH[latin], leakage.MAX_GAP[latin], leakage.MIN_RUN[latin]
    runs, best = [], {}
    for i in range(len(text)):
        for j in range(len(passage)):
            if text[i] == passage[j] and (i == 0 or j == 0 or text[i - 1] != passage[j - 1]):
                n = next((k for k in range(min(len(text) - i, len(passage) - j)) if text[i + k] != passage[j + k]), min(len(text) - i, len(passage) - j))
                runs += [(i, j, n)] if n >= shortest else []
    for i, j, n in runs:
        options = [n if n >= least else 0]
        for (i2, j2, n2), s in best.items():
            before, after = j - j2 - n2, i - i2 - n2
            new = n - max(0, -before, -after)
            if new > 0 and j2 <= j:
                if max(before, after) <= gap:
                    options.append((s or n2) + new + max(0, before))
                elif s and new >= least:
                    options.append(s + new)
        best[i, j, n] = max(options) if max(options) >= least else 0
    return min(1.0, max(best.values(), default=0) / len(passage))


def template_texts(rng, n: int, latin: bool) -> list[str]:
    """Texts of the same phrases in orders of their own, with other names between them."""
    name = (lambda k: "".join(rng.choice(list("bcdfg"), k))) if latin else (lambda k: ideographs(rng, k))
    phrases = [name(int(k)) for k in rng.integers(9, 30, 8)]
    return ["".join(phrases[k] + name(int(rng.integers(1, 30))) for k in rng.integers(0, 8, 6)) for _ in range(n)]


@pytest.mark.parametrize("places", [1 << 21, 60])
def test_exact_check_against_brute_force(table, monkeypatch, places):
    monkeypatch.setattr(leakage, "_PLACES", places)
    rng = np.random.default_rng(15)
    shared = [template_texts(rng, 14, latin) for latin in (True, False)]
    passages = [*shared[0][:6], *shared[1][:6], "다라" * 30 + ideographs(rng, 30)]
    texts = [*shared[0][6:], *shared[1][6:], "", "나다", passages[0][:80] + passages[7], passages[0][40:] + passages[0][:60], "라" + "다라" * 50, passages[12][20:] + "다" * 300]
    for share in (0.1, 0.5):
        want = {(d, k): s for d, t in enumerate(texts) for k, p in enumerate(passages) if (s := held_by_force(t, p)) >= share}
        got = leakage.verified(*leakage.letters(texts, table), items_of(passages, table), share)
        assert {(d, k): s for d, k, s in got} == want and len(got) == len(want) > 4


def test_exact_check_takes_all_pairs_at_once(table):
    """Texts made of the passages' phrases are candidates that don't hold them: the check may not work pair by pair."""
    rng = np.random.default_rng(16)
    texts = template_texts(rng, 420, True)
    items, calls = items_of(texts[:20], table), []
    for few in (texts[20:120], texts[20:420]):
        p, o = leakage.letters(few, table)
        n = [0]

        def count(frame, event, arg, n=n):
            n[0] += event in ("call", "c_call")

        sys.setprofile(count)
        leakage.verified(p, o, items, 0.5)
        sys.setprofile(None)
        calls.append(n[0])
    assert calls[1] < 2 * calls[0]


REAL = "흔한 홍수는 대눈터의 점흐진을 헤아려 졍어하에서 많았다. 담비가 해벙을 적고 현구고의 시장부터 돌아왔다. "


@pytest.mark.parametrize("text", [
    REAL + "{{ title }}", REAL + "${author}", "제목: [INSERT TITLE HERE]\n" + REAL, REAL + "［저자를 기입할 것］", REAL + "<제목을(를) 여기에 쓰시오>", REAL + "%(year)s園", REAL + "__PAGE_NO__",
    "Lorem ipsum dolor sit amet aliqua dolor tempor", "zxcvb zxcv zzvvb", "ㅁㄴㄴㄹㅇ ㅁㄴㅇㅁㅎㅁ ㅁㄴㅎㄹㅎㅁㅇ", "ㅁㄴㅇㄹ ㅁㄴㅇ로 ㅎㅗㅇㄹ", "가나다라 가나다 다라마바", "원문 뷰어\n오류가 발생하였습니다 (410)\n이전 화면으로", "Document viewer\nPlease enable JavaScript to continue.",
])
def test_residue_is_found(spark, text):
    df = spark.createDataFrame([(1, text)] + [(i, REAL) for i in range(2, 8)], "doc_id int, text string")
    assert [r["doc_id"] for r in residue.residue_documents(df, "doc_id", "text").collect()] == [1]


def test_long_placeholders():
    own = residue.Placeholders(residue.X.table())
    for blank in (
        "[insert the full title of the volume here]", "[이 책의 완전한 제목과 저자의 이름을 여기에 입력하세요]", "[escriba el nombre completo del autor del libro]", "<Insert title, year and (if known) the place of this volume>",
        "[insert " + "the full name of the author and " * 20 + "title here]", "{{ a value of more than four words }}", "[insert\nname here]",
    ):
        assert own.find(REAL + blank + " " + REAL), blank
    for note in ("[about three lines of the text are illegible here]", "[enter the king with his three sons]", "[insert the full title\nof the volume which is lost here] ", "[insert the name" + " of the clerk" * 40, "성명 ____ 이라 쓴 칸 다음에 주소라 쓴 ____", "(" * 400):
        assert own.find(REAL + note + " " + REAL) is None, note


#: Pages that no exemplar states in these words.
UNLISTED = (
    "Oops! The page can't be found here. It may have been moved or removed.", "Sorry, this page could not be found on the server. Please check the address.", "The server encountered an error and could not complete the request. Please try again.",
    "Access to this page was denied. Please contact the administrator.", "요청하신 페이지를 찾을 수 없습니다. 주소를 다시 확인해 주십시오.", "서버 오류가 발생하였습니다. 잠시 후 다시 접속하여 주십시오.", "La página no se ha encontrado. Compruebe la dirección e inténtelo de nuevo.",
    "La page demandée est introuvable. Veuillez vérifier l'adresse.", "ページは見つかりませんでした。アドレスを確認してください。", "Please enable scripts in your browser to view this document.", "이 원문을 보려면 자바스크립트를 허용해 주십시오.", "Habilite JavaScript en su navegador para continuar.",
)


def test_unlisted_pages(spark):
    df = spark.createDataFrame(list(enumerate((*UNLISTED, *[REAL] * 30))), "doc_id int, text string")
    found = residue.residue_documents(df, "doc_id", "text").collect()
    assert len({r["doc_id"] for r in found} & set(range(len(UNLISTED)))) >= 0.9 * len(UNLISTED) and all(r["doc_id"] < len(UNLISTED) and r["exemplar"] and r["coverage"] >= 0.5 for r in found)


def test_own_exemplars(spark):
    df = spark.createDataFrame([(1, "Under construction, come back soon."), (2, "Please enable JavaScript to continue."), (3, REAL + "[[fill: name]]"), (4, REAL), (5, "qqxx xxqq qxqx")], "doc_id int, text string")
    own = spark.createDataFrame([("error_page", "Under construction, come back soon", 0), ("placeholder", "[[ fill : W ]]", 0), ("filler_letters", "qx", 0), (None, "x", 0), ("filler", None, 0)], "label string, text string, doc_id int")
    got = {r["doc_id"]: (r["reason"], r["exemplar"]) for r in residue.residue_documents(df, "doc_id", "text", own).collect()}
    assert got == {1: ("error_page", "Under construction, come back soon"), 3: ("placeholder", "[[ fill : W ]]"), 5: ("filler", "qx")}


def test_real_texts_are_kept(spark):
    texts = [None, "", " \n", REAL, REAL * 3 + "\nPlease enable JavaScript to continue.", REAL + "{追記}", REAL + "□□□ 二字缺", REAL + "[역주 67]", "서식에는 성명 ______ 이라 쓴 칸이 있었다. " + REAL, REAL + "<家書> 條", LONG, "12. 3. 4"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, reason string")
    assert residue.residue_documents(df, "doc_id", "text").collect() == []
    assert residue.residue_documents(df.limit(0), "doc_id", "text").collect() == []


ENGLISH = ["The clerk of the town was sent away in the morning.", "A gate of the old temple was closed by the river.", "The letter was copied in the spring and sent to the council."]
KOREAN = ["마을의 노인이 편지를 읽었다.", "시장에서 소금을 팔고 돌아왔다.", "학교의 책방은 오래된 그림을 옮겼다."]


def test_languages_of_mixed_documents(spark):
    rng = np.random.default_rng(3)
    rows = [(f"e{i}", " ".join(rng.permutation(ENGLISH)), "en") for i in range(30)] + [(f"k{i}", " ".join(rng.permutation(KOREAN)), " Korean ") for i in range(30)]
    rows += [("wrong", ENGLISH[0], "kor"), ("none", KOREAN[0], None), ("odd", KOREAN[1], "??"), ("mix", KOREAN[0] + "\n\n" + ENGLISH[1] + "\n" + KOREAN[2] + KOREAN[1] * 3, "kor"), ("null", None, "en"), ("digits", "12 34", "en"), ("empty", "", None), ("odd", KOREAN[1], "??")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id string, text string, language string, segment_no int")
    names = spark.createDataFrame([("en", "eng_Latn"), ("kor", "kor_Hang"), ("Korean", "kor_Hang")], "language_label string, language string")
    got = {(r["id"], r["segment_no"]): r["language"] for r in language.label_repairs(df, "id", "text", "language", names).collect()}
    assert got == {("wrong", 0): "eng_Latn", ("none", 0): "kor_Hang", ("odd", 0): "kor_Hang", ("mix", 1): "kor_Hang", ("mix", 3): "eng_Latn", ("mix", 4): "kor_Hang"}
    assert language.label_repairs(df.limit(0), "id", "text", "language", names).count() == 0


SPANISH = ["El escribano de la villa fue enviado por la mañana.", "Una puerta del viejo templo se cerró junto al río.", "La carta se copió en primavera y llegó al consejo."]


def test_three_languages_in_one_line(spark):
    rng = np.random.default_rng(8)
    rows = [(f"{x}{i}", " ".join(rng.permutation(texts)), x) for x, texts in (("en", ENGLISH), ("kor", KOREAN), ("es", SPANISH)) for i in range(30)]
    rows += [("mix", "앞줄이다.\n" + ENGLISH[1] + " " + KOREAN[0] + " " + SPANISH[2], "en"), ("mix", "앞줄이다.\n" + ENGLISH[1] + " " + KOREAN[0] + " " + SPANISH[2], "en"), ("null", None, None), ("empty", "", "en")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id string, text string, language string, part_no int")
    names = spark.createDataFrame([("en", "eng_Latn"), ("kor", "kor_Hang"), ("es", "spa_Latn")], "language_label string, language string")
    found = [r for r in language.line_parts(df, "id", "text", "language", names).orderBy("id", "segment_no", "part_no").collect() if r["id"] == "mix"]
    assert [(r["segment_no"], r["part_no"], r["language"]) for r in found] == [(2, 1, "eng_Latn"), (2, 2, "kor_Hang"), (2, 3, "spa_Latn")]
    whole = "앞줄이다.\n" + ENGLISH[1] + " " + KOREAN[0] + " " + SPANISH[2]
    assert [whole[r["from_char"] : r["to_char"]] for r in found] == [t[:-1] for t in (ENGLISH[1], KOREAN[0], SPANISH[2])] and all(r["confidence"] > 0.5 for r in found)
    model = language.fit(df, "id", "text", "language", names)
    # a language follows itself most readily, and others can follow
    assert (model.transition.argmax(axis=1) == np.arange(3)).all() and np.abs(model.transition - np.diag(np.diag(model.transition))).max() > 0
    assert language.line_parts(df.limit(0), "id", "text", "language", names).count() == 0


def test_forward_backward_against_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    e, s, t = rng.normal(size=(4, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    p = np.zeros((4, 3))
    for y in itertools.product(range(3), repeat=4):
        w = np.exp(s[y[0]] + sum(e[i, y[i]] for i in range(4)) + sum(t[y[i], y[i + 1]] for i in range(3)))
        for i in range(4):
            p[i, y[i]] += w
    m, *_ = language.forward_backward(e.astype(np.float32), np.zeros(4, int), s.astype(np.float32), t.astype(np.float32))
    assert np.allclose(m, p / p.sum(axis=1, keepdims=True), atol=1e-4)


def test_permutation_is_one_to_one():
    for n in (1, 2, 7, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 99).tolist()) == list(range(n))


VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def test_mix_shares_and_repeats(spark):
    docs = [(i, "word " * int(20 + i % 50), ("big" if i % 3 else "small ") if i % 11 else "BIG") for i in range(400)] + [(900, None, "big"), (901, "", "big"), (902, "x", None), (903, "x y", "stranger")]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id bigint, text string, source string, n_tokens int").repartition(4)
    targets = spark.createDataFrame([("m", "big", 0.3, 2), ("m", "small", 0.6, 3), ("m", "absent", 0.1, 3)], "mix_name string, source string, target_share double, max_repeats int")
    pieces, plan = mixing.mix(df, "doc_id", "text", "source", targets, VOCABULARY, block=32)
    report = {r["source"]: r for r in mixing.mix_report(pieces, plan).collect()}
    assert report["big"]["actual_share"] == pytest.approx(1 / 3, abs=1e-4) and report["small"]["actual_share"] == pytest.approx(2 / 3, abs=1e-4)
    assert report["absent"]["actual_tokens"] == 0 and [report[s]["unmet"] for s in ("absent", "big", "small")] == ["no tokens", None, None]
    counts = {d[0]: len(mixing.encoder(VOCABULARY).encode_ordinary(d[1])) for d in docs[:400]}
    assert report["big"]["available_tokens"] + report["small"]["available_tokens"] == sum(counts.values())
    assert all(r["actual_tokens"] == r["planned_tokens"] for r in report.values())
    used, slots = {}, {}
    for p in pieces.collect():
        slots[p["shard"], p["slot"]] = slots.get((p["shard"], p["slot"]), 0) + p["n_tokens"]
        for t in range(p["from_token"], p["from_token"] + p["n_tokens"]):
            used[p["doc_id"], t] = used.get((p["doc_id"], t), 0) + 1
    source = {d[0]: d[2].strip().lower() for d in docs[:400]}
    assert all(n <= (3 if source[d] == "small" else 2) for (d, _), n in used.items()) and all(t < counts[d] for d, t in used)
    # only the last block of a source in each round, and its last slot, may be short
    assert max(slots.values()) == 32 and sum(n < 32 for n in slots.values()) <= 3 + 2 + 2
    # the scarcest source is used up, to its last token
    assert sum(n for (d, _), n in used.items() if source[d] == "small") in (3 * report["small"]["available_tokens"], report["small"]["planned_tokens"])
    pieces, _ = mixing.mix(df.limit(0), "doc_id", "text", "source", targets, VOCABULARY)
    assert pieces.count() == 0


def test_sources_of_less_than_a_block_keep_their_share(spark):
    docs = [(i, "word " * 40, "big") for i in range(50)] + [(99, "word " * 25, "tiny")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("m", "big", 0.5, 4), ("m", "tiny", 0.5, 4)], "mix_name string, source string, target_share double, max_repeats int")
    pieces, plan = mixing.mix(df, "doc_id", "text", "source", targets, VOCABULARY)
    report = {r["source"]: r for r in mixing.mix_report(pieces, plan).collect()}
    assert report["tiny"]["actual_tokens"] == 4 * report["tiny"]["available_tokens"] == report["big"]["actual_tokens"] > 0
    pieces, plan = mixing.mix(df, "doc_id", "text", "source", targets, VOCABULARY, total_tokens=10_000)
    report = {r["source"]: r for r in mixing.mix_report(pieces, plan).collect()}
    assert report["tiny"]["unmet"] == "repeats used up" and report["tiny"]["actual_share"] == 0.5


def test_draws_beyond_a_sources_slots_go_to_the_others(spark):
    import pandas as pd

    plan = mixing.plan_mix(pd.DataFrame({"source": list("abc"), "target_share": [0.5, 0.3, 0.2], "max_repeats": [2, 2, 2]}), {"a": 5000, "b": 3001, "c": 777}, 10, None)
    rows = mixing._slots(spark, {"m": plan}, 10, 3, slots_per_shard=7).toPandas()
    assert rows.groupby("source").size().to_dict() == dict(zip(plan["source"], plan["slots"], strict=True))
    assert not rows.duplicated(["source", "block", "repeat"]).any() and not rows.duplicated(["shard", "slot"]).any() and rows["due"].between(1, 10).all()
    assert rows["repeat"].max() <= 1
