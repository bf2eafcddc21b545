import random

from pyspark.sql import functions as F

from skein.llm.pages import closeness, common, first_link, without_shared


def plain_lcs(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    return n[-1][-1]


def test_common_is_longest():
    rnd = random.Random(4)
    for _ in range(200):
        a, b = ([rnd.choice("abcde") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        got = common(a, b)
        rest = iter(b)
        assert len(got) == plain_lcs(a, b) and got == sorted(set(got)) and all(a[k] in rest for k in got)


def test_pages(spark):
    rows = [
        ("a", "x.example", "/news/1", "Menu\nStory one\n\nImprint"), ("b", "x.example", "/news/2", "Menu\nStory two\nImprint"),
        ("c", "x.example", "/shop/9", "Menu\nKettles\nBasket"), ("d", "y.example", "/", "Menu\nAlone"), ("e", None, "/", "Menu"), ("f", "x.example", "/news/3", None), ("g", "x.example", None, ""),
    ]
    df = spark.createDataFrame(rows, "id string, host string, path string, t string").withColumn("n", F.lit(1))
    got = {r.id: (r.text, r.n_lines, r.n_shared) for r in without_shared(df, "id", "host", "path", "t").collect()}
    assert got["a"] == ("Story one\n", 3, 2) and got["b"] == ("Story two", 3, 2) and got["c"][0] == "Kettles\nBasket"
    assert got["d"] == ("Menu\nAlone", 2, 0) and got["e"] == ("Menu", 1, 0) and got["f"] == (None, 0, 0) and got["g"] == ("", 0, 0)
    assert without_shared(df.limit(0), "id", "host", "path", "t").count() == 0
    assert closeness("/a/b/c", "/a/b/d") == 2 and closeness("/", "/x") == 0
    link = spark.createDataFrame([("see https://X.example/a/b?q=1 ok",), ("none",)], "t string").select(*[c.alias(n) for c, n in zip(first_link("t"), ("h", "p"))]).collect()
    assert tuple(link[0]) == ("x.example", "/a/b") and tuple(link[1]) == (None, None)
