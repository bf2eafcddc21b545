import pytest

from skein.llm.markup import clean, strip_markup, with_markup

CASES = [
    ("Plain text, 2*3*6 screws & more < 5.", []),
    ("Look in C:\\temp\\new_files for snake_case_name.", []),
    ("My #1 reason is price, and I <3 the colour.", []),
    ("It costs $5 to $14 and R&D is free. If a < b and b > c it lies ~9 [sic].", []),
    ("Dear [[NAME]], __USER__ {{date}} <your city> <%= x %> ${y} %(z)s [INSERT X HERE]", []),
    ("see https://a.example/x_y_z and f*ck", []),
    ("a **bold** move", ["markdown"]),
    ("# Head\ntext", ["markdown"]),
    ("one\n- two\n- three", ["markdown"]),
    ("[see here](https://x.example/1 broken", ["markdown"]),
    ("run `x` now", ["markdown"]),
    ("text</span></td> more", ["html"]),
    ("a&nbsp;b &amp;lt;i&amp;gt;c", ["html"]),
    ("'''bold''' and [[Page|word]]", ["wiki"]),
    ("{{cite|title=T}} x", ["wiki"]),
    ("\\begin{equation}\nx_{1}\n\\end{equation}", ["latex"]),
    ("\\textbf{x} and $$ \\sum k $$", ["latex"]),
]


@pytest.mark.parametrize("text,kinds", CASES)
def test_kinds(text, kinds):
    out, got = clean(text)
    assert got == kinds
    if not kinds:
        assert out == text


def test_structure_is_kept():
    out, _ = clean(
        "<h2>Top</h2><ul><li>one</li><li><b>two</b></li></ul><pre><code>a < b\n</code></pre>"
        "<a href='https://x.example'>here</a> $x_{1}$"
    )
    for part in ("## Top", "- one", "- two", "```\na < b\n```", "here (https://x.example)", "$x_{1}$"):
        assert part in out
    assert clean("== Head ==\n{|\n|-\n| a || b\n|}")[0] == "# Head\na | b"


def test_tables(spark):
    long = "**x** " * 20000
    rows = [(1, None, 0), (2, "", 0), (3, "plain", 0), (4, "**a**", 0), (4, "**a**", 0), (5, long, 0)]
    df = spark.createDataFrame(rows, "id long, t string, kinds int")
    got = sorted((r.id, r.text, tuple(r.kinds)) for r in strip_markup(df, "id", "t").collect() if r.text)
    assert got[0] == ("3", "plain", ()) and got[1] == got[2] == ("4", "a", ("markdown",))
    assert "*" not in got[3][1]
    assert strip_markup(df, "id", "t").count() == 6
    assert {r.id for r in with_markup(df, "id", "t").collect()} == {"4", "5"}
    assert with_markup(df.limit(0), "id", "t").count() == 0
