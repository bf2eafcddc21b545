import unicodedata

from skein.llm.visual import look_alike_pairs, unify


def run(spark, texts):
    rows = [(k, t, "x") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, t string, unified string")
    return {r.id: r.unified for r in unify(df, "id", "t").collect()}, df


def test_forms(spark):
    texts = [
        None, "", "plain", "Ｗｉｄｅ　ｔｅｘｔ", "naïve", "naïve", "соfé",
        "a​b­c", "👩‍🌾 ok", "👩🌾 ok", "ﬁne", "½ ① m²", "ệ", "ệ",
        "́x", "a\r\nb",
    ]
    got, _ = run(spark, texts)
    assert [got[k] for k in range(len(texts))] == [
        None, "", "plain", "Wide text", "naïve", "naïve", "cofé", "abc", "👩‍🌾 ok", "👩🌾 ok", "fine",
        "½ ① m²", "ệ", "ệ", "́x", "a\nb",
    ]


def test_pairs_against_brute_force(spark):
    texts = ["café", "café", "café", "ｃafé", "cafe", "Café", None, "", "", "​", "x²", "x2"] * 2
    _, df = run(spark, texts)
    got = {(r.id_a, r.id_b) for r in look_alike_pairs(df, "id", "t").collect()}

    def look(t):
        t = t.replace("​", "").replace("ｃ", "c")
        return unicodedata.normalize("NFC", t)

    want = {
        (a, b)
        for a, x in enumerate(texts)
        for b, y in enumerate(texts)
        if a < b and x is not None and y is not None and x != y and look(x) == look(y)
    }
    assert got == want


def test_long_and_empty(spark):
    got, df = run(spark, ["é" * 20000 + "x" * 50000])
    assert got[0] == "é" * 20000 + "x" * 50000
    assert unify(df.limit(0), "id", "t").count() == 0
    assert look_alike_pairs(df.limit(0), "id", "t").count() == 0
