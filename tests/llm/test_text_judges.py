import random

import pytest
from pyspark.sql import functions as F

from tarn.llm import languages, prose, quality, stuffing
from tarn.llm.labels import languages_of, named_language
from tarn.llm.languages import Profiles, fit_profiles, word_grams

random.seed(8)
PARTS = {
    "en": (["the crawler", "our reader", "a small index", "the old archive"], ["reads", "keeps", "checks", "counts"], ["the missing pages of the list", "a copy of the report", "the weight of each term"], ["during the night", "after the restart", "because it was late"]),
    "de": (["der Crawler", "die Redaktion", "ein alter Index", "das Archiv"], ["liest", "prüft", "zählt", "sammelt"], ["die fehlenden Seiten der Liste", "eine Kopie des Berichts", "das Gewicht jedes Begriffs"], ["während der Nacht", "nach dem Neustart", "weil es spät war"]),
    "fr": (["le robot", "la rédaction", "un vieil index", "cette archive"], ["lit", "vérifie", "compte", "garde"], ["les pages perdues de la liste", "une copie du rapport", "le poids de chaque terme"], ["durant la nuit", "après le redémarrage", "parce que c'était tard"]),
}


def sentence(lang):
    a, b, c, d = (random.choice(x) for x in PARTS[lang])
    s = f"{a} {b} {c} {d}."
    return s[0].upper() + s[1:]


def article(lang, n=8):
    return "\n".join(" ".join(sentence(lang) for _ in range(2)) for _ in range(n))


def corpus():
    return [(i, lang, article(lang)) for i, lang in enumerate(["en"] * 40 + ["de"] * 30 + ["fr"] * 30)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    keywords = ["cheap relay", "bulk keys", "free mirror", "top vault"]
    stuffed = [
        (200, "en", " ".join(random.choice(keywords) for _ in range(120)).capitalize() + "."),
        (201, "de", "\n".join(f"https://x{i}.example/q{i}a" for i in range(30))),
        (202, None, " ".join(f"#{random.choice(keywords).replace(' ', '')}" for _ in range(40))),
        (203, "en", sentence("en") + "\n" + "\n".join(f"{random.choice(keywords)}, {random.choice(keywords)}, name{i}" for i in range(40))),
    ]
    other = [(300, "en", ""), (301, "en", None), (302, "und", article("de")), (303, "en", article("fr")), (304, "English", article("en") + "\n" + sentence("de") + " " + sentence("de")), (305, None, "Menu\nTop"), (304, "English", None)]
    return spark.createDataFrame(rows + stuffed + stuffed[:2] + other, "seq long, lang string, content string")


def test_labels(spark):
    given = ["en", "EN", "en_GB", "en-US", "eng", "English", " Deutsch ", "por", "xx", "und", "", None, "unknown", "русский", "it", "N/A", "?"]
    df = spark.createDataFrame([(x,) for x in given], "l string")
    assert [r[0] for r in df.select(named_language("l")).collect()] == ["en", "en", "en", "en", "en", "en", "de", "pt", None, None, None, None, None, "ru", "it", None, None]
    assert languages_of(df, "l") == ["de", "en", "it", "pt", "ru"] and languages_of(df, "l", 0.2) == ["en"] and languages_of(df.where("false"), "l") == []


def test_stuffed_pages(docs):
    assert {r.seq for r in stuffing.stuffed_pages(docs).collect()} == {200, 201, 202, 203} | {305}
    rows = {r.seq: r for r in stuffing.judged(docs).collect()}
    assert 300 not in rows and 301 not in rows and rows[200].level > 5 and rows[0].prose > 0.8
    assert rows[40].spoken == "de" and rows[303].spoken == "fr" and rows[0].slope < 0


def test_each_fact_flags(spark):
    """Prose on a line by length; a text that departs from it in one fact alone."""
    rng = random.Random(1)
    names = "version long, lang string, length double, divergence double, level double, slope double, residual double"
    prose_rows = [(i, "en" if i % 2 else "de", x, 0.1 + rng.gauss(0, 0.02), 0.3 * x, -0.1 * x, 0.2) for i in range(400) for x in [4 + i % 7 / 3]]
    odd = [(1000, "en", 5.0, 1.3, 1.5, -0.5, 0.2), (1001, "en", 5.0, 0.1, 2.7, -0.5, 0.2), (1002, "de", 5.0, 0.1, 1.5, -1.7, 0.2), (1003, "xx", 5.0, 0.1, 1.5, -0.5, 1.4), (1004, None, 9.0, 0.1, 2.7, -0.9, 0.2), (1005, "en", 5.0, -1.0, 0.4, -0.5, 0.2)]
    facts = spark.createDataFrame(prose_rows + odd, names)
    usual = stuffing._usual(facts.where("version < 1000"))
    assert {r.version for r in stuffing._departures(facts, usual, ()).where(F.col("departure") > stuffing.FLAGGED).collect()} == {1000}
    assert {r.version for r in stuffing._departures(facts, usual).where(F.col("departure") > stuffing.FLAGGED).collect()} == {1000, 1001, 1002, 1003}


def test_language_that_only_labels_know(spark):
    """A language outside the alias table is learned from its labels."""
    rng = random.Random(6)
    syllables = ["zu", "ke", "wa", "nta", "mbi", "li", "ngo", "shi", "po", "ya"]
    lexicon = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(30)]
    rows = [(2000 + i, "swa", "\n".join(" ".join(rng.choice(lexicon) for _ in range(12)).capitalize() + "." for _ in range(8))) for i in range(40)]
    df = spark.createDataFrame(corpus() + rows + [(3000, "en", rows[0][2])], "seq long, lang string, content string")
    got = {(r.seq, r.line_no): r.lang for r in languages.judged_lines(df).collect()}
    assert got[2000, 0] == got[3000, 0] == "swa" and got[0, 0] == "en"
    assert {r.seq for r in stuffing.stuffed_pages(df).collect()} == set()


def test_stuffing_of_nothing(spark):
    none = spark.createDataFrame([], "seq long, lang string, content string")
    assert stuffing.stuffed_pages(none).count() == 0 and prose.word_weights(none, "content", "lang") == {}
    blank = spark.createDataFrame([(1, None, "  \n"), (2, None, None)], none.schema)
    assert stuffing.judged(blank).count() == 0


def test_languages(docs):
    got = {(r.seq, r.line_no, r.lang) for r in languages.found_languages(docs, stuffing.stuffed_pages(docs)).collect()}
    assert got == {(302, 0, "de"), (303, 0, "fr"), (304, 9, "de")}
    rows = languages.judged_lines(docs).where("line_no = 0").collect()
    assert {r.seq for r in rows} == {r.seq for r in docs.collect()}
    blank = {300, 301}
    assert all(0 < r.confidence <= 1 and r.lang for r in rows if r.seq not in blank | {304})
    assert all((r.lang, r.confidence, r.running) == (None, 0.0, False) for r in rows if r.seq in blank)
    assert [r.running for r in rows if r.seq == 305] == [False]


def test_held_out_accuracy(spark, docs):
    judge = Profiles(fit_profiles(docs))
    asked = [(lang, sentence(lang)) for lang in PARTS for _ in range(60)]
    right = [found == lang for found, (lang, _) in zip(judge.wholes([s for _, s in asked]), asked, strict=True)]
    assert sum(right) / len(right) > 0.98


def test_profiles_of_nothing(spark):
    none = spark.createDataFrame([], "seq long, lang string, content string")
    assert fit_profiles(none) == {} and languages.judged_lines(none).count() == 0
    unlabelled = spark.createDataFrame([(1, None, article("en"))], none.schema)
    assert [(r.line_no, r.lang, r.confidence, r.running) for r in languages.judged_lines(unlabelled).collect()] == [(0, None, 0.0, False)]


def test_sample_is_bounded(docs):
    few = fit_profiles(docs, max_rows=30)
    assert set(few) <= set(PARTS) and all(len(r) <= languages.PROFILE for r in few.values())


def test_distance_by_definition():
    ranks = {"en": {g: i for i, g in enumerate(["e", "_t", "th"])}, "de": {"e": 5}}
    judge = Profiles(ranks)
    own = sorted(set(word_grams("the")), key=lambda g: languages._tie(g))
    out = [sum(abs(i - ranks[lang][g]) if g in ranks[lang] else languages.PROFILE for i, g in enumerate(own)) / (languages.PROFILE * len(own)) for lang in judge.langs]
    assert judge.distances([["the"]])[0].tolist() == pytest.approx(out)


def test_distances_of_many_are_those_of_each(docs, monkeypatch):
    judge = Profiles(fit_profiles(docs))
    texts = [sentence(lang).lower().split() for lang in PARTS for _ in range(20)] + [["x"], ["zq"] * 30]
    each = [judge.distances([t])[0].tolist() for t in texts]
    assert judge.distances(texts).tolist() == each
    monkeypatch.setattr(languages, "CHUNK_GRAMS", 300)
    assert judge.distances(texts).tolist() == each and judge.distances([]).shape == (0, len(PARTS))


@pytest.fixture(scope="module")
def measured(spark):
    rows = [(i, t, lang) for i, lang, t in corpus()]
    special = {
        500: None, 501: "", 502: "  ", 503: "x" * 400, 504: "la " * 150, 505: "|/%&{[" * 30, 506: "Known limits\n" + "=-" * 100,
        507: "\n".join(f"name{i}a = {i * 37}" for i in range(40)), 508: article("de").encode().decode("latin-1"), 509: article("en").upper(),
        510: article("fr").replace(" ", "\n"), 511: article("en") + "\n- one\n- two\n- three", 512: "Short.", 513: article("en") + article("de"),
        514: "\n".join(f"- item{i}z top{i}q" for i in range(30)), 515: "\n".join(sentence("en") + f" Then {chr(97 + i % 26) * 3}{chr(97 + i // 26) * 2} stores it." for i in range(400)), 516: "5bef 8159 93b4 " * 30,
    }
    df = spark.createDataFrame(rows + [(k, t, None) for k, t in special.items()], "doc_id long, text string, lang string")
    common = spark.createDataFrame([("en", "the", 1), ("en", None, 2), ("de", "Der", 1)], "lang string, word string, rank_no int")
    return df, common


def test_statistics(measured):
    rows = {r.doc_id: r for r in quality.statistics(*measured).collect()}
    assert rows[500].n_chars == 0 and not rows[500].is_prose and rows[501].n_words == 0
    assert rows[0].ended_lines == 1 and rows[0].common_words > 0.1 and rows[0].duplicate_lines < 0.5
    assert rows[505].symbol_ratio == 1 and rows[504].top_pair_chars > 0.9 and rows[504].level > 100
    assert rows[509].prose == pytest.approx(1, abs=0.5) and rows[508].garbled > 0.03


def test_not_prose(measured):
    got = {r.doc_id for r in quality.not_prose(*measured).collect()}
    assert got == {503, 504, 505, 506, 507, 508, 514, 516}


def test_quality_of_empty_tables(spark, measured):
    df, common = measured
    assert quality.not_prose(df.where("false"), common.where("false")).count() == 0
    assert quality.statistics(df.where("doc_id = 0"), common.where("false")).first().common_words == 0


WITH_URL = "seq long, lang string, content string, url string"


def spread_pages(rows):
    return [(k, lang, t, f"http://h{k % 50}.example/{k}") for k, lang, t in rows]


def test_copies_of_a_stuffed_page_teach_nothing(spark):
    rng = random.Random(3)
    text = " ".join(rng.choice(["cheap relay", "bulk keys", "free mirror", "top vault"]) for _ in range(60))
    copies = [(1000 + i, "en", text, f"http://c{i}.example/") for i in range(60)]
    df = spark.createDataFrame(spread_pages(corpus()) + copies + copies[:30], WITH_URL)
    assert {r.seq for r in stuffing.stuffed_pages(df).collect()} == {r[0] for r in copies}
    documents, common = df.selectExpr("seq AS doc_id", "content AS text", "lang", "url"), spark.createDataFrame([("en", "the", 1)], "lang string, word string, rank_no int")
    assert {r.doc_id for r in quality.not_prose(documents, common).collect()} == {r[0] for r in copies}


def test_pages_of_a_stuffed_site_teach_nothing(spark):
    rng = random.Random(4)
    site = [(1000 + i, "en", " ".join(rng.choice(["cheap relay", "bulk keys", "free mirror", "top vault"]) for _ in range(60)), f"http://S.example:80/{i}") for i in range(60)]
    df = spark.createDataFrame(spread_pages(corpus()) + site, WITH_URL)
    assert not {"cheap", "vault"} & {w for w, x in prose.largest(prose.word_weights(df, "content", "lang")).items() if x > 0.5}
    assert {r.seq for r in stuffing.stuffed_pages(df).collect()} == {r[0] for r in site}


def test_site_caps(spark):
    even = [("de", f"s{i}", 10) for i in range(100)]
    sizes = spark.createDataFrame([*even, ("de", "big", 3000), ("de", "next", 200), ("fr", "a", 7), ("fr", "b", 1)], "lang string, site string, texts long")
    caps = prose.site_caps(sizes)
    assert caps["de"] == pytest.approx(prose.MAX_SITE * (1000 + 2 * caps["de"])) and caps["fr"] == 8


def test_repetition_is_not_prose():
    weights = dict.fromkeys("abcdefghijklmnopqrstuvwxyz", 1.0) | {f"{a}{b}": 1.0 for a in "abcdefgh" for b in "nopqrstu"}
    known = sorted(w for w in weights if len(w) == 2)
    one = quality.Measure(set(), weights)
    is_prose = lambda text: one(text)[-1]
    paragraph = " ".join(known[:45]) + "."
    assert is_prose(paragraph) and is_prose(" ".join(known) + ".")
    assert not is_prose("\n\n".join([paragraph] * 1000)) and not is_prose(" ".join([paragraph] * 3))
    assert not is_prose(" ".join([" ".join(known[:12]) + "."] * 7))
    rng = random.Random(2)
    lines = [" ".join(rng.sample(known, 9)) + "." for _ in range(10)]
    assert not is_prose("\n".join(rng.choice(lines) for _ in range(60)))  # in any order
    assert not is_prose(". ".join(" ".join(rng.sample(known[:45], 45)) for _ in range(60)) + ".")  # few words, shuffled
    assert is_prose("\n".join(lines)) and is_prose("\n".join([*lines, lines[0]]))
