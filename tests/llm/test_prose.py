import math

import numpy as np
import pytest

from skyloom.llm import prose as P

PROSE = {
    "en": "I bought this for my brother and it was a good choice. We looked at the moon from the garden, and the picture is sharp. It will not shake when you turn it.",
    "de": "Ich habe das Gerät für meinen Bruder gekauft und er ist sehr zufrieden. Wir waren im Garten, aber es war nicht dunkel. Es ist leicht und man hat viel Freude.",
    "fr": "Je suis ravi de cet achat et il est très solide. Nous avons vu la lune dans le jardin, mais il faisait froid. Ce n'est pas cher pour ce que c'est.",
    "ru": "Я купил его для брата, и он очень доволен. Мы смотрели на луну, но было не так темно. Это не дорого для того, что есть.",
    "ja": "友人へのプレゼントとして買いました。庭で月を見ましたが、とても明るいです。使いやすいので、買ってよかったと思います。",
}
JUNK = [
    "\n".join(f"- lens {i}\n- case, strap" for i in range(12)),
    "\n".join(f"lens | {i} | n/a | {i * 3}%" for i in range(12)),
    "qwkjh zxmnb plokij wsxedc rfvtgb yhnujm " * 8,
    "!!!! ???? #### $$$$ %%%% &&&& **** ~~~~ ^^^^ ====",
    "nice nice nice nice nice nice nice nice nice nice nice nice nice",
]


def corpus(n=600, seed=0):
    """Rows of texts put together from the sentences of ``PROSE``."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lang = list(PROSE)[i % 5]
        parts = PROSE[lang].replace("。", "。 ").split(" ") if lang == "ja" else PROSE[lang].split(". ")
        text = ". ".join(x.rstrip(".") for x in rng.permutation(parts)) + "." if lang != "ja" else "".join(rng.permutation(parts))
        rows.append((i, text, lang, "x"))
    return rows


@pytest.fixture(scope="module")
def words(spark):
    return P.learn(spark.createDataFrame(corpus(), "doc_id long, text string, lang string, distance string"))


@pytest.mark.parametrize("lang", list(PROSE))
def test_prose_reads_as_prose(lang, words):
    s = dict(zip(P.STATS.names[1:], P.statistics(PROSE[lang], "xx", words)))
    assert s["language"] == lang and s["sentence_ratio"] > 0.9 and s["line_end_ratio"] == 1 and s["common_ratio"] > 0.2


@pytest.mark.parametrize("text", JUNK)
def test_junk_does_not(text, words):
    s = dict(zip(P.STATS.names[1:], P.statistics(text, "en", words)))
    assert s["sentence_ratio"] < 0.2


def test_values_of_a_known_text():
    s = dict(zip(P.STATS.names[1:], P.statistics("The cat is on it.\n\nno 12 <b>#</b>", None, P.Words(["en"], {"en": ["it", "is", "the"]}, {}, {"en": 0.5}, {"en": [*range(97, 123)]}))))
    assert (s["n_words"], s["n_chars"], s["n_trimmed"]) == (6, 33, 33)
    assert s["word_length"] == pytest.approx((3 + 3 + 2 + 2 + 2 + 2) / 6) and s["line_end_ratio"] == 0.5
    solid = len("Thecatisonit.no12#")
    assert s["symbol_ratio"] == pytest.approx(1 / solid) and s["digit_ratio"] == pytest.approx(2 / solid)
    assert s["common_ratio"] == pytest.approx(3 / 6) and s["log_words"] == pytest.approx(math.log(7))


@pytest.mark.parametrize("text", [None, "", "  \n\t "])
def test_empty_texts(text):
    assert P.statistics(text, "de")[0] == "de" and not any(P.statistics(text, "de")[3:])


@pytest.mark.parametrize("said, code", [("EN", "en"), ("de_DE", "de"), ("jp", "ja"), (None, "und"), ("klingon", "und"), ("deutsch", "de")])
def test_declared_languages(said, code):
    assert P.declared(said) == code


def test_found_and_contributions(spark):
    rows = corpus()
    junk = [(1000 + i, t, "en", "x") for i, t in enumerate(JUNK)]
    odd = [(2000, None, "en", "x"), (2001, "", "en", "x"), (2002, "short list - a - b", "en", "x"), (2003, PROSE["en"].upper(), None, "x"), (2004, "lens " * 50_000, "en", "x"), (2004, "lens " * 50_000, "en", "x")]
    df = spark.createDataFrame(rows + junk + odd, "doc_id long, text string, lang string, distance string")
    assert sorted(r["doc_id"] for r in P.not_prose(df).collect()) == [1000, 1001, 1002, 1003, 1004, 2004, 2004]
    scored = P.score(df).collect()
    assert len(scored) == len(rows + junk + odd)
    for r in scored:
        assert sum(r["contributions"].values()) == pytest.approx(r["distance"], abs=1e-6) and set(r["contributions"]) == set(P.STATISTICS)
    assert P.not_prose(df.limit(0)).count() == 0
    assert P.not_prose(df.where("doc_id = 2000").drop("lang")).count() == 0


def test_distances_match_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, len(P.STATISTICS)))
    fits = {"": (np.zeros(9), np.eye(9)), "en": (np.ones(9), np.diag(np.arange(1.0, 10)))}
    parts = P._parts(x, ["en", "de"] * 25, fits)
    for row, p, lang in zip(x, parts, ["en", "de"] * 25):
        m, inv = fits["en" if lang == "en" else ""]
        away = np.array([d if side * d >= 0 else 0.0 for d, side in zip(row - m, P.AWAY)])
        assert p.sum() == pytest.approx(away @ inv @ away)


FOREIGN = {
    "pl": "Kupiłem ten teleskop dla mojego brata i jest bardzo zadowolony. Oglądaliśmy Księżyc z ogrodu, ale było dość zimno. Statyw jest lekki, a obraz ostry.",
    "zh": "我给弟弟买了这台望远镜，他非常喜欢。昨晚我们在花园里看了月亮，图像很清晰。三脚架很轻，但是有点不稳。总的来说，我很满意。",
    "ko": "동생을 위해 이 망원경을 샀는데 아주 마음에 들어 합니다. 어젯밤에 정원에서 달을 보았고 화면이 선명했습니다. 전체적으로 만족합니다.",
}
FOREIGN_LIST = "- statyw\n- obiektyw 23 mm\n- pasek, śruba\n- łącznik + osłona\n- uchwyt 5 kg\n- szukacz"


def test_prose_of_languages_that_were_not_learned(spark):
    odd = [(2000 + 10 * i + j, t, lang, "x") for i, (k, t) in enumerate(FOREIGN.items()) for j, lang in enumerate((k, None, "en"))]
    odd += [(3000 + j, FOREIGN_LIST, lang, "x") for j, lang in enumerate(("pl", None, "en"))]
    df = spark.createDataFrame(corpus() + odd, "doc_id long, text string, lang string, distance string")
    assert sorted(r["doc_id"] for r in P.not_prose(df).collect()) == [3000, 3001, 3002]
    assert {r["language"] for r in P.score(df).where("doc_id >= 2000").collect()} == {"und"}


def test_the_distance_alone_decides(spark):
    """What is listed is what is far; other limits list other texts."""
    mixed = [(1000 + k, PROSE["en"] + "\n" + JUNK[0][: 40 * k], "en", "x") for k in range(6)]
    df = spark.createDataFrame(corpus() + mixed, "doc_id long, text string, lang string, distance string")
    d = {r["doc_id"]: r["distance"] for r in P.score(df).where("n_trimmed >= 40").collect()}
    listed = [{r["doc_id"] for r in P.not_prose(df, far=far).collect()} for far in (5.0, 27.877, 1e9)]
    assert listed == [{k for k, v in d.items() if v > far} for far in (5.0, 27.877, 1e9)]
    assert len(listed[0]) > len(listed[1]) > 0 == len(listed[2])
    assert d[1000] < d[1002] < d[1004]


def test_differences_towards_prose_do_not_count():
    fits = {"": (np.zeros(9), np.eye(9))}
    assert P._parts(np.multiply(P.AWAY, -1.0)[None, :], [""], fits).sum() == 0
    assert P._parts(np.array(P.AWAY, float)[None, :], [""], fits).sum() == sum(map(abs, P.AWAY))


def test_words_are_learned(words):
    assert set(words.languages) == set(PROSE)
    assert {"und", "ist", "nicht"} <= set(words.ties["de"]) and "qwkjh" not in words.common["en"]
    lists = [("en", w, s, f, 9, 1000, 500, 50) for w, s, f in (("the", 60, 40), ("and", 40, 0), ("lens", 5, 60))]
    w = P._words(lists, 4.0)
    assert w.ties["en"] == ["and"] and w.usual["en"] == pytest.approx(0.105)


def test_arrays_equal_regular_expressions():
    """The counts of many odd texts at once are those of one text at a time by patterns."""
    import pyarrow as pa
    import regex

    rng = np.random.default_rng(5)
    alphabet = list("aäB c.!?\n\t;|/#12-–'\"(é") + ["\u0301", "\ufe0f", "日", "の", "ー", "。", "ไ", "د", "👍🏽", "<b>", "&amp;", "...", "\u2028", "  ", "\U00020000", "한", "\ue000"]
    texts = ["".join(rng.choice(alphabet, int(rng.integers(0, 60)))) for _ in range(400)] + ["", "x" * 3000]
    clean = P._clean(pa.array(texts))
    _, n_words, m = P._statistics(clean, ["und"] * len(texts), P.Words())
    own = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in P.UNSPACED) + "]"
    blank = "[\\s\ue000\x1c-\x1f]"
    for t, n, row in zip(clean, n_words, m):
        words = regex.findall(r"[\p{L}\p{M}]*\p{L}[\p{L}\p{M}]*", regex.sub(own, " ", t))
        k = len(regex.findall(own, t))
        assert n == len(words) + -(-k // 2)
        solid = regex.sub(blank, "", t)
        if not solid:
            assert not row.any()
            continue
        assert row[1] == pytest.approx((sum(map(len, words)) + k) / max(n, 1))
        assert row[3] == pytest.approx(len(regex.findall(r"\p{Nd}", solid)) / len(solid))
        lines = [x for x in regex.split("[\n\r\u2028\u2029\x85]", t) if regex.sub(blank, "", x)]
        assert row[4] == pytest.approx(sum(bool(regex.search(r"[.!?。！？…:][\s\ue000\"')\]»”’>*_~]*$", x)) for x in lines) / len(lines))
