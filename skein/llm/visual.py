"""One consistent form for texts that look the same but are made of different characters.

Texts holding anything beyond ASCII are exploded to positioned pieces (an ASCII run is one
piece, every other code point its own), each code point is replaced through a broadcast join
with a fixed table (decomposition, width, spaces, invisible characters, look-alike letters),
combining marks are put in the order of their classes, clusters are recomposed by a second
broadcast join, and the strings are rebuilt.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Letters of other scripts drawn like a Latin letter, and their Latin twins.
LOOK_ALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j",
    "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "А": "A", "В": "B",
    "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y",
    "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I", "Ԍ": "G",
    # Greek
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H",
    "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "Ϲ": "C", "Ϳ": "J",
    # Armenian and Latin extensions
    "օ": "o", "ս": "u", "հ": "h", "զ": "q", "ց": "g", "Տ": "S", "Ս": "U", "Օ": "O",
    "ɑ": "a", "ɡ": "g", "ǃ": "!", "ꞵ": "β", "ß": "ß",
    # signs
    "µ": "μ", "‐": "-", "‑": "-", "ʼ": "’", "∶": ":", "․": ".", "։": ":", "‧": "·", "∙": "·",
    "⋅": "·", "∕": "/", "⁄": "/", "ꓸ": ".",
}

# Code points that are not drawn at all.
INVISIBLE = [
    0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E,
    0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0x2066,
    0x2067, 0x2068, 0x2069, 0x206A, 0x206B, 0x206C, 0x206D, 0x206E, 0x206F, 0xFEFF, 0xFFF9,
    0xFFFA, 0xFFFB,
]

#: An emoji joined from several, or one with a variation selector: left as it is.
_EMOJI = (
    r"\p{So}[\x{1F3FB}-\x{1F3FF}\x{FE0F}]*(?:\x{200D}\p{So}[\x{1F3FB}-\x{1F3FF}\x{FE0F}]*)+"
)
#: Letters of scripts in which joiners change the shape keep them.
_SHAPED = r"[\p{IsArabic}\p{IsDevanagari}\p{IsBengali}\p{IsTamil}\p{IsMalayalam}\p{IsSinhala}]"
_PIECES = (
    rf"{_EMOJI}|{_SHAPED}\p{{M}}*[\x{{200C}}\x{{200D}}](?={_SHAPED})"
    r"|[\x00-\x7f]+(?=[\x00-\x7f])|[\x00-\x7f]|[^\x00-\x7f]"
)

_SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>")


def _target(ch: str) -> str:
    """What stands for one code point: decomposed, of plain width, in Latin twins."""
    cp = ord(ch)
    if cp in _INVISIBLE:
        return ""
    if unicodedata.category(ch) == "Zs":
        return " "
    ligature = 0xFB00 <= cp <= 0xFB06 or cp in (0x132, 0x133) or 0x1C4 <= cp <= 0x1CC
    ligature = ligature or 0x1F1 <= cp <= 0x1F3 or 0x2160 <= cp <= 0x217F
    if ligature or unicodedata.decomposition(ch).startswith(_SAME_LOOK):
        ch = unicodedata.normalize("NFKD", ch)
    return "".join(LOOK_ALIKES.get(c, c) for c in unicodedata.normalize("NFD", ch))


_INVISIBLE = frozenset(INVISIBLE)


@cache
def _tables() -> tuple[list, list]:
    """(ch, [(c, ccc)...]) of every code point that changes or is a mark; (cluster, composite)."""
    single, composed = [], {}
    for cp in range(0x80, 0x110000):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue  # Hangul syllables stand for themselves
        ch = chr(cp)
        if not unicodedata.name(ch, "") and unicodedata.category(ch) not in ("Cf", "Zs"):
            continue
        to = _target(ch)
        if to != ch or unicodedata.combining(ch):
            single.append((ch, [(c, unicodedata.combining(c)) for c in to]))
            whole = unicodedata.normalize("NFC", to)
            if len(to) > 1 and len(whole) == 1:
                composed[to] = whole
    return single, sorted(composed.items())


def _frames(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    single, composed = _tables()
    return (
        spark.createDataFrame(single, "ch string, to array<struct<c:string,ccc:int>>"),
        spark.createDataFrame(composed, "cluster string, whole string"),
    )


def unify(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, unified): the text of each row in the consistent form.

    ``key`` must be unique and is carried unchanged. A null text stays null and an empty one
    empty; texts of ASCII alone only get their line ends unified. Whole texts are processed,
    however long; extra columns are dropped, whatever their names. An empty table gives an
    empty result.
    """
    single, composed = _frames(df.sparkSession)
    rows = df.select(F.col(key).alias("k"), F.regexp_replace(text, "\r\n?", "\n").alias("t"))
    wide = F.col("t").rlike(r"[^\x00-\x7f]")
    plain = rows.filter(~wide | F.col("t").isNull()).select("k", F.col("t").alias("unified"))
    pieces = rows.filter(wide).select(
        "k", F.posexplode(F.regexp_extract_all("t", F.lit(_PIECES), F.lit(0))).alias("pos", "ch")
    )
    itself = F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("ccc")))
    points = pieces.join(F.broadcast(single), "ch", "left").select(
        "k", "pos", F.posexplode_outer(F.coalesce("to", itself)).alias("sub", "x")
    )
    points = points.select("k", "pos", "sub", F.col("x.c").alias("c"), F.col("x.ccc").alias("ccc"))
    points = points.repartition("k")
    in_order = Window.partitionBy("k").orderBy("pos", "sub")
    starter = F.coalesce(F.col("ccc"), F.lit(0)) == 0
    # a starter opens a cluster; a removed character (c null) opens none and joins the last
    opens = (starter & F.col("c").isNotNull()).cast("int")
    points = points.withColumn("cluster", F.sum(opens).over(in_order))
    clusters = points.groupBy("k", "cluster").agg(
        F.max(F.when(starter, F.col("c"))).alias("base"),
        F.array_sort(
            F.collect_list(F.when(~starter, F.struct("ccc", "pos", "sub", "c")))
        ).alias("marks"),
    )
    marks = F.transform("marks", lambda m: m["c"])
    base = F.coalesce("base", F.lit(""))
    many = F.size("marks") > 0
    clusters = clusters.select(
        "k",
        "cluster",
        F.when(many, F.concat(base, F.array_join(marks, ""))).otherwise(base).alias("s"),
        F.when(many, F.concat(base, F.element_at(marks, 1))).alias("head"),
        F.when(many, F.array_join(F.slice(marks, 2, F.size("marks")), "")).alias("tail"),
    )
    first = composed.select(F.col("cluster").alias("head"), F.col("whole").alias("begun"))
    full = composed.select(F.col("cluster").alias("s"), "whole")
    clusters = (
        clusters.join(F.broadcast(full), "s", "left")
        .join(F.broadcast(first), "head", "left")
        .withColumn("s", F.coalesce("whole", F.concat("begun", "tail"), "s"))
    )
    rebuilt = clusters.groupBy("k").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("cluster", "s"))), lambda p: p["s"]
            ),
            "",
        ).alias("unified")
    )
    return plain.unionByName(rebuilt).select(F.col("k").alias(key), "unified")


def _digest(c: Column) -> Column:
    return F.unhex(F.sha1(c))


def look_alike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, look, text_hash): ``look`` is equal for rows that look the same, ``text_hash`` for
    rows equal in every code point. Rows with a null text are left out."""
    raw = df.select(key, _digest(text).alias("text_hash")).filter(F.col("text_hash").isNotNull())
    look = unify(df, key, text).select(key, _digest("unified").alias("look"))
    return raw.join(look, key)


def look_alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key_a, key_b), key_a < key_b: rows that differ in code points but look the same.

    Pairs are formed between distinct texts first and then expanded to the rows that hold them,
    so copies of one text are never paired with each other.
    """
    rows = look_alike_classes(df, key, text)
    kinds = rows.select("look", "text_hash").distinct()
    more = kinds.groupBy("look").count().filter(F.col("count") > 1).select("look")
    kinds = kinds.join(more, "look", "left_semi")
    a = kinds.select("look", F.col("text_hash").alias("ha"))
    b = kinds.select("look", F.col("text_hash").alias("hb"))
    pairs = a.join(b, "look").filter(F.col("ha") < F.col("hb")).select("ha", "hb")
    left = rows.select(F.col("text_hash").alias("ha"), F.col(key).alias("ka"))
    right = rows.select(F.col("text_hash").alias("hb"), F.col(key).alias("kb"))
    out = pairs.join(left, "ha").join(right, "hb")
    return out.select(
        F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b")
    )
