"""Markup to clean text: HTML, Markdown, wiki text and LaTeX, whole or broken.

A text is read by a chain of small readers. Code and formulas are set aside first so that no
later reader touches them; then entities, HTML, LaTeX, wiki and Markdown constructs are turned
into one plain notation: ``# `` headings, ``- `` list items, fenced or back-quoted code,
``$formula$``, ``text (url)`` links and ``a | b`` table rows. Which families of markup were met
is reported with the text. Placeholders, prices, paths and lone signs are left alone.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The element names of HTML that occur in text bodies, and wiki extension tags.
TAGS = (
    "a abbr address article aside b big blockquote body br button caption center cite code col "
    "colgroup dd del details div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html i iframe img input ins kbd label li link main mark meta nav noscript ol "
    "option p pre q s samp script section select small span strike strong style sub summary sup "
    "svg table tbody td textarea tfoot th thead title tr tt u ul var video "
    "ref references nowiki gallery math poem blockquote syntaxhighlight"
).split()
_NAME = "|".join(sorted(TAGS, key=len, reverse=True))
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,30});")
_TAG = re.compile(
    rf"<!--.*?-->|<!doctype\b[^>]*>|<(/?)({_NAME})((?:\s+[^<>]*|\s*)/?)>"
    rf"|<({_NAME})\s+[a-zA-Z-]+\s*=\s*[\"'][^<>]*$",
    re.I | re.S,
)
_HREF = re.compile(r"href\s*=\s*[\"']?([^\"'\s>]+)", re.I)
_DROP = re.compile(r"<(script|style)\b[^<>]*>.*?</\1\s*>", re.I | re.S)
_PRE = re.compile(r"<pre\b[^<>]*>(.*?)</pre\s*>", re.I | re.S)
_CODE = re.compile(r"<(code|kbd|samp|tt)\b[^<>]*>(.*?)</\1\s*>", re.I | re.S)
_MATH = re.compile(r"<math\b[^<>]*>(.*?)</math\s*>", re.I | re.S)
_ANCHOR = re.compile(r"<a\b([^<>]*)>(.*?)</a\s*>", re.I | re.S)
_FENCE = re.compile(r"^[ \t]*(```+|~~~+)[^\n`]*\n(.*?)(?:^[ \t]*\1[ \t]*$|\Z)", re.M | re.S)
_TICKS = re.compile(r"(?<!`)(`{1,2})(?!`)([^\n]+?)(?<!`)\1(?!`)")
_DISPLAY = re.compile(
    r"\\begin\{(equation|align|gather|math|displaymath|eqnarray)(\*?)\}(.*?)(?:\\end\{\1\2\}|\Z)"
    r"|\\\[(.+?)\\\]|\\\((.+?)\\\)|\$\$(.+?)\$\$",
    re.S,
)
_INLINE = re.compile(r"(?<![\\$\w])\$(?=[^\s$])([^$\n]*?[\\^_={][^$\n]*?)(?<=[^\s$])\$(?![\w$])")
_ENV = re.compile(r"[ \t]*\\(?:begin|end)\{[a-zA-Z]+\*?\}(?:\[[^\]\n]*\])?[ \t]*\n?")
_SECTION = re.compile(r"^[ \t]*\\(?:(sub)*section|chapter|paragraph|part)\*?\{([^{}\n]*)\}", re.M)
_ITEM = re.compile(r"^[ \t]*\\item\b(?:\[[^\]\n]*\])?[ \t]*", re.M)
_LINK_TEX = re.compile(r"\\href\{([^{}]*)\}\{([^{}]*)\}|\\url\{([^{}]*)\}")
_MACRO = re.compile(
    r"\\(?:text(?:bf|it|tt|sc|sf|rm|sl|up)?|emph|underline|mathbf|mathrm|caption|label|ref|cite"
    r"|footnote|title|author|usepackage|documentclass|verb)\*?(?:\[[^\]\n]*\])?"
    r"\{((?:[^{}]|\{[^{}]*\})*)\}?"
)
_MACRO_BARE = re.compile(
    r"\\(?:frac|sqrt|sum|int|alpha|beta|gamma|delta|lambda|theta|cdot|times|leq|geq|infty|ldots"
    r"|noindent|bigskip|medskip|newline|maketitle|par)(?![a-zA-Z])(?:\{[^{}]*\})*"
)
_WIKI_TABLE = re.compile(r"^\{\|.*?(?:^\|\}|\Z)", re.M | re.S)
_WIKI_HEAD = re.compile(r"^[ \t]*(={2,6})[ \t]*([^=\n][^\n]*?)[ \t]*\1[ \t]*$", re.M)
_WIKI_LINK = re.compile(r"\[\[([^\[\]|\n]+)\|([^\[\]\n]*)\]\]")
_WIKI_BARE = re.compile(r"\[\[([^\[\]|\n]+)\]\]")
_WIKI_URL = re.compile(r"(?<!\])\[((?:https?|ftp)://[^\s\[\]]+)[ \t]+([^\[\]\n]+)\](?!\()")
_WIKI_TEMPLATE = re.compile(r"\{\{([a-zA-Z#][\w #-]*)(\|[^{}]*)\}\}")
_WIKI_QUOTES = re.compile(r"('{2,5})(?=[^'\s])([^\n]*?[^'\s])\1(?!')")
_IMAGE = re.compile(r"!\[([^\[\]\n]*)\]\(([^()\s]+)(?:\s+\"[^\"\n]*\")?\)")
_LINK = re.compile(r"\[([^\[\]\n]+)\]\(((?:https?://|/|#|mailto:|www\.)[^()\s]*)(?:\s+\"[^\"\n]*\")?\)")
_LINK_BROKEN = re.compile(r"!?\[([^\[\]\n]+)\]\(((?:https?://|www\.)[^()\s]*)(?=\s|$)")
_HEAD = re.compile(r"^[ ]{0,3}(#{1,6})[ \t]+([^\n]*?)[ \t]*#*[ \t]*$", re.M)
_SETEXT = re.compile(r"^[ ]{0,3}(?=\S)([^\n]+)\n[ ]{0,3}(={3,}|-{3,})[ \t]*$", re.M)
_RULE = re.compile(r"^[ ]{0,3}(?:\*[ ]?){3,}$|^[ ]{0,3}(?:_[ ]?){3,}$|^[ ]{0,3}-{3,}[ \t]*$", re.M)
_BULLET = re.compile(r"^([ \t]*)[*+-][ \t]+(?=\S)", re.M)
_NUMBER = re.compile(r"^[ \t]*\d{1,3}[.)][ \t]+(?=\S)", re.M)
_WIKI_BULLET = re.compile(r"^(?:\*{1,4}|#{2,4}|:{1,3})[ \t]*(?=[^\s*#:])(?![^\n*]*\*[^\n]*$)", re.M)
_QUOTE = re.compile(r"^[ ]{0,3}>[ \t]+(?=\S)|^[ ]{0,3}>(?=[A-Za-z])", re.M)
_MD_ROW = re.compile(r"^[ \t]*\|(.+)\|[ \t]*$", re.M)
_MD_RULE = re.compile(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*\n?", re.M)
_SPOILER = re.compile(r">!(?=\S)([^\n]*?\S)!<")
_STRIKE = re.compile(r"~~(?=\S)([^\n]*?\S)~~")
_STRONG = re.compile(r"\*\*(?=[^\s*])([^\n]*?[^\s*])\*\*|(?<!\w)__(?=[^\s_])([^\n]*?[^\s_])__(?!\w)")
_EM = re.compile(
    r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*?[^\s*])\*(?![\w*])"
    r"|(?<![\w*])\*(?=[A-Za-zÀ-ÿ])([^*\n]*?[^\s*])\*(?=[A-Za-zÀ-ÿ])"
    r"|(?<![\w_])_(?=[^\s_])([^_\n]*?[^\s_])_(?![\w_])"
)
_PLACEHOLDER = re.compile(r"[A-Z][A-Z0-9 ._-]*")
_BLANKS = re.compile(r"\n{3,}")

#: A text without any of these holds no markup; checked on the JVM side before Python.
MAYBE = (
    r"[<>*~`\[{|\\$]|&[#a-zA-Z]|''|_\S|(?m)^[ \t]*(?:#|=|-|\+|\d{1,3}[.)]\s|:)"
)


class _Reader:
    """State of one text: what was set aside, and the families met."""

    def __init__(self) -> None:
        self.kept: list[str] = []
        self.kinds: set[str] = set()

    def keep(self, text: str) -> str:
        self.kept.append(text)
        return f"\x00{len(self.kept) - 1}\x00"

    def restore(self, text: str) -> str:
        while "\x00" in text:
            new = re.sub(r"\x00(\d+)\x00", lambda m: self.kept[int(m[1])], text)
            if new == text:
                return text.replace("\x00", "")
            text = new
        return text

    def sub(self, kind: str, pattern: re.Pattern, to, text: str) -> str:
        new, n = pattern.subn(to, text)
        if n:
            self.kinds.add(kind)
        return new

    def fence(self, body: str) -> str:
        return "\n" + self.keep("```\n" + html.unescape(body).strip("\n") + "\n```") + "\n"


def clean(text: str) -> tuple[str, list[str]]:
    """(text in the plain notation, sorted families of markup met)."""
    r = _Reader()
    t = text.replace("\x00", "").replace("\r\n", "\n")
    t = r.sub("markdown", _FENCE, lambda m: r.fence(m[2]), t)
    t = r.sub("html", _PRE, lambda m: r.fence(_TAG.sub("", m[1])), t)
    if "`" in t:
        t = r.sub("markdown", _TICKS, lambda m: r.keep(f"`{m[2].strip()}`"), t)
    t = _entities(r, t)
    if "<" in t:
        t = _from_html(r, t)
    if "\\" in t or "$" in t:
        t = _from_latex(r, t)
    t = _from_wiki(r, t)
    t = _from_markdown(r, t)
    if not r.kinds:
        return text, []
    t = r.restore(t)
    return _BLANKS.sub("\n\n", re.sub(r"[ \t]+(?=\n|$)", "", t)).strip("\n"), sorted(r.kinds)


def _entities(r: _Reader, t: str) -> str:
    for _ in range(3):
        hit = False

        def known(m: re.Match) -> str:
            nonlocal hit
            if m[0][1] != "#" and m[0][1:] not in html5:
                return m[0]
            hit = True
            return html.unescape(m[0]).replace("\xa0", " ").replace("\x00", "")

        t = _ENTITY.sub(known, t) if "&" in t else t
        if not hit:
            break
        r.kinds.add("html")
    return t


def _from_html(r: _Reader, t: str) -> str:
    t = r.sub("html", _DROP, "", t)
    t = r.sub("html", _MATH, lambda m: r.keep(f"${m[1].strip()}$"), t)
    t = r.sub("html", _CODE, lambda m: r.keep(f"`{m[2].strip()}`"), t)

    def anchor(m: re.Match) -> str:
        url = _HREF.search(m[1])
        return f"{m[2]} ({url[1]})" if url else m[2]

    t = r.sub("html", _ANCHOR, anchor, t)

    def tag(m: re.Match) -> str:
        r.kinds.add("html")
        name, close = (m[2] or "").lower(), m[1] == "/"
        if len(name) == 2 and name[0] == "h" and name[1].isdigit():
            return "\n\n" if close else "\n\n" + r.keep("#" * int(name[1]) + " ")
        if name == "li":
            return "" if close else r.keep("- ")
        if name in ("br", "tr", "div", "table", "ul", "ol", "hr", "dt", "dd", "title"):
            return "\n"
        if name in ("p", "blockquote", "section", "article", "header", "center"):
            return "\n\n" if close else "\n"
        if name in ("td", "th"):
            return " | " if close else ""
        return ""

    return _TAG.sub(tag, t)


def _from_latex(r: _Reader, t: str) -> str:
    def formula(m: re.Match) -> str:
        body = next((g for g in m.groups()[2:] if g), "").strip()
        return r.keep(f"${body}$")

    t = r.sub("latex", _DISPLAY, formula, t)
    t = r.sub("latex", _INLINE, lambda m: r.keep(f"${m[1]}$"), t)
    if "\\" in t:
        t = r.sub("latex", _SECTION, lambda m: "\n" + r.keep("# ") + m[2] + "\n", t)
        t = r.sub("latex", _ITEM, lambda m: r.keep("- "), t)
        t = r.sub("latex", _ENV, "\n", t)
        t = r.sub("latex", _LINK_TEX, lambda m: m[3] or f"{m[2]} ({m[1]})", t)
        for _ in range(2):
            t = r.sub("latex", _MACRO, lambda m: m[1], t)
        t = r.sub("latex", _MACRO_BARE, lambda m: r.keep(f"${m[0]}$"), t)
    return t


def _from_wiki(r: _Reader, t: str) -> str:
    if "{|" in t:

        def table(m: re.Match) -> str:
            rows = []
            for line in m[0].split("\n")[1:]:
                line = line.strip()
                if line.startswith(("|}", "|-", "{|")) or not line.startswith(("|", "!")):
                    continue
                cells = re.split(r"\|\||!!", line.lstrip("|!+"))
                rows.append(" | ".join(c.strip() for c in cells))
            return r.keep("\n".join(rows)) + "\n"

        t = r.sub("wiki", _WIKI_TABLE, table, t)
    if "==" in t:
        t = r.sub("wiki", _WIKI_HEAD, lambda m: r.keep("#" * (len(m[1]) - 1) + " ") + m[2], t)
    if "[" in t:
        t = r.sub("wiki", _WIKI_LINK, lambda m: m[2] or m[1], t)

        def bare(m: re.Match) -> str:
            if _PLACEHOLDER.fullmatch(m[1].strip()):
                return m[0]
            r.kinds.add("wiki")
            return m[1]

        t = _WIKI_BARE.sub(bare, t)
        t = r.sub("wiki", _WIKI_URL, lambda m: f"{m[2]} ({m[1]})", t)
    if "{{" in t:

        def template(m: re.Match) -> str:
            named = dict(p.split("=", 1) for p in m[2].split("|") if "=" in p)
            return named.get("title", named.get("text", "")).strip()

        t = r.sub("wiki", _WIKI_TEMPLATE, template, t)
    if "''" in t:
        t = r.sub("wiki", _WIKI_QUOTES, lambda m: m[2], t)
    return t


def _from_markdown(r: _Reader, t: str) -> str:
    if "[" in t:
        t = r.sub("markdown", _IMAGE, lambda m: f"{m[1]} ({m[2]})", t)
        t = r.sub("markdown", _LINK, lambda m: f"{m[1]} ({m[2]})", t)
        t = r.sub("markdown", _LINK_BROKEN, lambda m: f"{m[1]} ({m[2]})", t)
    if "#" in t:
        t = r.sub("markdown", _HEAD, lambda m: r.keep(m[1] + " ") + m[2], t)
    if "===" in t or "---" in t:
        t = r.sub("markdown", _MD_RULE, "", t)
        t = r.sub("markdown", _SETEXT, lambda m: r.keep("# ") + m[1], t)
    if "|" in t:
        t = r.sub(
            "markdown", _MD_ROW, lambda m: " | ".join(c.strip() for c in m[1].split("|")), t
        )
    t = r.sub("markdown", _RULE, "", t)
    if ">" in t:
        t = r.sub("markdown", _SPOILER, lambda m: m[1], t)
        t = r.sub("markdown", _QUOTE, lambda m: r.keep("> "), t)
    if "~~" in t:
        t = r.sub("markdown", _STRIKE, lambda m: m[1], t)
    t = r.sub("markdown", _BULLET, lambda m: m[1] + r.keep("- "), t)
    t = r.sub("markdown", _NUMBER, lambda m: r.keep(m[0]), t)
    if "*" in t or "_" in t:
        for _ in range(2):
            t = _STRONG.sub(lambda m: _bold(r, m), t)
            t = _EM.sub(lambda m: _bold(r, m), t)
    return t


def _bold(r: _Reader, m: re.Match) -> str:
    body = next(g for g in m.groups() if g is not None)
    if m[0].startswith("_") and _PLACEHOLDER.fullmatch(body):
        return m[0]
    r.kinds.add("markdown")
    return body


_OUT = pa.schema([("k", pa.string()), ("text", pa.string()), ("kinds", pa.list_(pa.string()))])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [clean(t) for t in batch.column(1).to_pylist()]
        texts = pa.array([d[0] for d in done], pa.string())
        kinds = pa.array([d[1] for d in done], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0), texts, kinds], schema=_OUT)


def strip_markup(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key as string, text, kinds): clean text and the sorted families of markup met.

    ``kinds`` is empty where the text has no markup; then the text comes out unchanged. Null
    texts stay null with empty kinds, empty ones empty. Repeated rows come out repeated; extra
    columns are dropped, whatever their names. Whole texts are read, however long.
    """
    rows = df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("text"))
    maybe = F.coalesce(F.col("text").rlike(MAYBE), F.lit(False))
    plain = rows.filter(~maybe).withColumn("kinds", F.array().cast("array<string>"))
    marked = rows.filter(maybe).mapInArrow(_run, "k string, text string, kinds array<string>")
    return plain.unionByName(marked).withColumnRenamed("k", key)


def with_markup(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key as string, kinds) of the rows whose text holds markup, by the same reader."""
    rows = df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("text"))
    marked = rows.filter(F.col("text").rlike(MAYBE)).mapInArrow(
        _run, "k string, text string, kinds array<string>"
    )
    return marked.filter(F.size("kinds") > 0).select(F.col("k").alias(key), "kinds")
