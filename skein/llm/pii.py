"""Personal information in free text, replaced by typed placeholders.

Each text is rewritten by small transducers that keep, for every character they emit, the span
of the source it came from: look-alike characters, widths, invisible characters and markup signs
are normalised, spelled digits become digits. Identifiers are detected on the normalised text,
and their spans are mapped back, so all other characters of the source stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.visual import LOOK_ALIKES

TYPES = ("email", "id_number", "phone", "address", "name")

# Given names that open a personal name.
GIVEN = (
    "Agnes Albert Alice Amelia Ana Andrea Andreas Anna Anne Antoine Antonio Bastian Beatrice Ben "
    "Bernd Bettina Camille Carla Carlos Carmen Caspar Catherine Charles Charlotte Christian "
    "Christine Claire Claudia Clara Daniel Daria Dario David Diego Dieter Dominik Edith Eduardo "
    "Elena Elias Elisabeth Elizabeth Elmo Emil Emilia Emma Enrique Erik Ernst Eva Fabian Felix "
    "Fernando Florian Francisco Frank Franz Frieda Gabriel Georg George Gerhard Greta Hannah Hans "
    "Harald Heinrich Helen Helena Henri Henrike Henry Ida Ilka Ines Ingrid Isabel Isabelle Ivan Ivo "
    "Jacques Jakob James Jan Jane Javier Jean Jens Johanna Johannes John Jonas Jorge Jose José Juan "
    "Julia Julian Julie Karin Karl Katharina Kathrin Klaus Lara Laura Lavinia Lena Leonie Linda Lisa "
    "Louis Louise Luca Lucas Lucia Luis Lukas Manuel Marek Margaret Maria María Marie Marta Martin "
    "Mary Matthias Max Michael Michel Miguel Mirela Monika Nadia Nicolas Nina Noemi Odile Olga Olivia "
    "Oskar Pablo Patricia Paul Paula Peter Petra Philipp Philippe Pierre Quentin Rafael Ralf Ricardo "
    "Richard Robert Rosa Rosalba Rufus Sabine Samuel Sandra Sara Sarah Silvia Silvio Sofia Sophie Stefan "
    "Stephan Sunniva Susanne Teresa Thea Thomas Tobias Tobin Ulf Ulrich Ursula Uwe Viola Walter Wanda "
    "William Yusra Yvonne Zeno"
).split()
#: Forms of address before a family name.
TITLES = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señora?|Sra?|Sir|Doña)"
# Capitalised words that may stand where a family name would, but are none.
NO_FAMILY = frozenset(
    "The This That These Those There Then They We You He She It If In On At And But Or So As For "
    "From With Who What When Where Which Why How Is Are Was Were Do Does Did Has Have Had My Your "
    "Our Their His Her Its Not No Yes Try Start Step Keep Can Could Would Should Am An After Before "
    "Last First Half Good Thanks Please Regards Best Signed Hi Hello Dear Greetings Cheers Hallo Hola "
    "Bonjour Ich Die Der Das Ein Eine Man Mein Meine Seit Ohne Und Am Im Hat Wenn Nach El La Los Las Un "
    "Una Mi Según Creo Llevo No Al Lo Le Les Une Mon Ma Je Il Au Chez Merci Est Last Nobody Nothing Out "
    "One More Small Between Compared Somebody Long Honestly Sounds Saludos Cordialement Gruß Grüße Love "
    "Street Road Lane Works Shop Store Station Garage".split()
)
# Words for single digits, by language.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5",
    "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6",
    "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7",
    "huit": "8", "neuf": "9",
}

_DIGIT = "|".join(sorted(SPELLED, key=len, reverse=True))
_SPELLED_RUN = re.compile(rf"\b(?:(?:{_DIGIT})\b[\s,;.\-]{{1,2}}){{5,}}(?:{_DIGIT})\b", re.I)
_SPELLED_ONE = re.compile(rf"\b(?:{_DIGIT})\b", re.I)
_MARKUP = re.compile(
    r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?>|&(?:amp;)?(?:lt|#60);/?[a-z]+&(?:amp;)?(?:gt|#62);"
    r"|\\(?:textbf|textit|emph|underline|text)\{|(?<=\w)\}|\*{1,3}|~~|'{2,5}|`|>!|!<"
    r"|\[\[[^\[\]|\n]*\||\]\]|\]\(https?://[^\s()]*\)?|(?<!\w)\[(?=[^\[\]\n]+\]\(https?:)"
)
_ENTITY = {"&#64;": "@", "&commat;": "@", "&#46;": ".", "&period;": ".", "&nbsp;": " "}
_ENTITY_RE = re.compile("|".join(map(re.escape, _ENTITY)))

_OPEN, _SHUT = r"[\[({<]\s*", r"\s*[\])}>]"
_AT = rf"(?:\s?@\s?|\s*{_OPEN}(?:at|@|ät|arroba|AT){_SHUT}\s*|\s+AT\s+|\s+at\s+(?=[\w-]+\s*(?:{_OPEN}dot|\sdot\s)))"
_DOT = rf"(?:\.|\s*{_OPEN}(?:dot|punkt|punto|point|DOT|\.){_SHUT}\s*|\s+(?:dot|DOT|punkt|punto)\s+)"
EMAIL = re.compile(
    rf"(?<![\w.+@/-])[A-Za-z0-9](?:[\w.+-]*\w)?{_AT}[A-Za-z0-9](?:[\w-]*\w)?"
    rf"(?:{_DOT}[A-Za-z0-9](?:[\w-]*\w)?)*{_DOT}[A-Za-z]{{2,24}}(?![\w@]|[:/]\w)"
)
_FILE = re.compile(r"\.(?:png|jpe?g|gif|svg|webp|bmp|ico|css|js|pdf|zip|mp[34])$|@\d+x\.", re.I)

_ID_WORD = (
    r"(?:SSN|(?i:social security)(?i: number| no\.?)?|NHS(?i: number| no\.?)?|NINO"
    r"|(?i:national insurance)(?i: number| no\.?)?|(?i:passport)(?i: number| no\.?| nr\.?)?"
    r"|(?i:reisepass(?:nummer)?|passnummer|(?:personal)?ausweis(?:nummer|-?nr\.?)?)|DNI|NIE|NIF"
    r"|(?i:driver'?s?|driving)[ -](?i:licen[cs]e)(?i: number| no\.?)?|(?i:führerschein(?:nummer)?)"
    r"|(?i:steuer-?id|steuernummer|sozialversicherungsnummer)|(?i:tax id|identity card|id card)"
    r"(?i: number| no\.?)?|(?i:pasaporte|passeport|carte d'identité)|(?i:numéro de sécurité sociale"
    r"|número de la seguridad social))"
)
ID_NUMBER = re.compile(
    rf"\b{_ID_WORD}[\s:#.]{{1,3}}(?:(?i:is|ist|es|est|nr|no)[\s:.]{{1,2}})?"
    r"((?=(?:[A-Z .-]*\d){5})[A-Z]{0,4}[ -]?\d(?:[ .-]?[A-Z0-9]){4,14})\b"
    r"|(?<![\w-])(\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<![\w-])([A-Z]{2} \d{2} \d{2} \d{2} [A-D]|[A-CEGHJ-PR-TW-Z]{2}\d{6}[A-D])(?![\w-])"
    r"|(?<![\w-])(\d{8}-?[A-HJ-NP-TV-Z])(?![\w-])"
    r"|(?<![\w-])([12] \d{2} (?:0[1-9]|1[0-2]) \d{2} \d{3} \d{3}(?: \d{2})?)(?![\w-])"
)
PHONE = re.compile(
    r"(?<![\w+.-])(?:\+\d{1,3}[ ./-]?(?:\(0?\d{1,4}\)[ ]?)?\d(?:[ ./-]?\d){6,12}"
    r"|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|(?:1[ .-])?\d{3}[.-]\d{3}[.-]\d{4}|\d{3} \d{3} \d{4}"
    r"|1[2-9]\d{2}[2-9]\d{6}|\(0\d{1,4}\)[ /-]?\d(?:[ /-]?\d){4,9}"
    r"|0\d{1,4}[ /-]\d{2,8}(?:[ -]\d{2,4}){0,4}|\d{3}-\d{4})(?![\w-]|[.,]\d)"
)
_WAY = (
    r"(?:[Ss]treet|[Ss]t|[Rr]oad|[Rr]d|[Ll]ane|[Ll]n|[Aa]venue|[Aa]ve|[Dd]rive|[Dd]r|[Tt]errace"
    r"|[Cc]lose|[Cc]rescent|[Cc]ourt|[Cc]t|[Ww]ay|[Pp]lace|[Ss]quare|[Gg]ardens|[Gg]rove"
    r"|[Bb]oulevard|[Bb]lvd|[Mm]ews)"
)
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]+"
_TOWN = rf"(?:,\s(?:\d{{4,5}}\s{_CAP}|{_CAP}\s\d{{4,5}})\b)?"
ADDRESS = re.compile(
    rf"(?:\b(?:(?:Flat|Apt|Apartment|Unit|Suite) ?\d+[a-z]?, ?)?\d{{1,4}}[a-z]?,? (?:{_CAP} ){{1,3}}{_WAY}\b\.?"
    r"(?:,? (?:apt|Apt|Flat|Unit)\.? ?\d+[a-z]?)?"
    rf"|\b\d{{1,4}}[a-z]? (?:[a-z]{{3,}} ){{1,2}}{_WAY}\.?,? (?:apt|flat|unit|suite|no)\.? ?\d+[a-z]?\b"
    r"|\b[A-ZÄÖÜ][\wäöüß-]*?(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|damm)\s\d{1,4}[a-z]?\b"
    r"|\b\d{1,4}(?: bis| ter)?,? (?:rue|avenue|boulevard|bd|place|chemin|impasse|allée|quai)\s"
    rf"(?:de la |du |des |de l['’]|de |d['’])?{_CAP}"
    r"|\b(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino|Ronda|Travesía)\s(?:de la |del |de los |de las |de )?"
    rf"{_CAP}(?: {_CAP}){{0,3}},?\s(?:n\.?º ?)?\d{{1,4}}\b){_TOWN}"
)
_GIVEN = "(?:" + "|".join(sorted(GIVEN, key=len, reverse=True)) + ")"
_PARTICLE = r"(?:(?:van der|van den|van de|van|von der|von|de la|del|de|di|da|zu|le|la|ten|ter) )?"
_NO = "(?!(?:" + "|".join(sorted(NO_FAMILY)) + r")\b)"
_FAMILY = rf"{_PARTICLE}({_NO}{_CAP})"
NAME = re.compile(
    rf"\b(?:{TITLES}\.?[ ](?:{_GIVEN}[ ])?(?:[A-ZÀ-Þ]\.[ ])?{_FAMILY}"
    rf"|{_GIVEN}(?:-{_GIVEN}|[ ]{_GIVEN})?[ ](?:[A-ZÀ-Þ]\.[ ])?{_FAMILY}"
    rf"|{_NO}({_CAP}),[ ]{_GIVEN}\b(?![ ](?:[A-Z]\.[ ])?{_PARTICLE}[A-ZÀ-Þ][\w'’-]{{3,}}ez?\b))"
)

# Words after which, or before which, two capitalised words name a person, whoever it is.
WHO = (
    "neighbou?r|landlord|landlady|brother|sister|uncle|aunt|cousin|boss|colleague|coworker|friend|teacher|tenant|husband|wife|father|mother"
    "|doctor|dentist|lawyer|manager|roommate|flatmate|Nachbar(?:in)?|Vermieter(?:in)?|Kolleg(?:e|in)|Freund(?:in)?|Chef(?:in)?"
    "|voisine?|propriétaire|collègue|amie?|vecin[oa]|caser[oa]|compañer[oa]|amig[oa]|jef[ea]"
)
BEFORE = rf"(?:(?i:my|our|his|her|their|mein|meine|unser|unsere|mon|ma|mi|the)[ ](?:{WHO})[ ]|(?i:signed(?: by)?|ask for|ask|yours|regards|sincerely|my name is|i am called|ich heiße|je m'appelle|me llamo)[,:]?[ ])"
AFTER = rf"(?:[ ]from[ ](?:next[ ]door|work|upstairs|downstairs|across)|[ ](?:called|phoned|rang|emailed|texted|signed|told[ ]me|lives)\b|,[ ](?:my|our|mein|meine|mon|ma|mi)[ ](?:{WHO})\b)"
_FIRST = rf"{_NO}[A-ZÀ-ÖØ-Þ][a-zß-ÿ’'-]{{1,}}"
#: A person nobody listed, by what stands next to the name; a number or a third capitalised word
#: after it speaks for a thing or a shop.
STRANGER = re.compile(
    rf"\b{BEFORE}({_FIRST}[ ](?:[A-ZÀ-Þ]\.[ ])?{_PARTICLE}{_NO}[A-ZÀ-ÖØ-Þ][a-zß-ÿ’'-]{{1,}})(?![\w-]|[ ](?:\d|[A-ZÀ-Þ][a-z]))"
    rf"|(?<![\w-])({_FIRST}[ ](?:[A-ZÀ-Þ]\.[ ])?{_PARTICLE}{_NO}[A-ZÀ-ÖØ-Þ][a-zß-ÿ’'-]{{1,}})(?={AFTER})"
)

_PARTICLES = "(?:van der|van den|van de|van|von der|von|de la|del|de|di|da|zu|le|la|ten|ter)"
_NEAR_BEFORE = rf"\b(?:(?i:my|our|his|her|their|mein|meine|unser|unsere|mon|ma|mi|the) (?:{WHO}) |(?i:signed(?: by)?|ask for|ask|yours|regards|sincerely|my name is|i am called|je m'appelle|me llamo)[,:]? )"
_NEAR_AFTER = rf"(?: from (?:next door|work|upstairs|downstairs|across)| (?:called|phoned|rang|emailed|texted|signed|told me|lives)\b|, (?:my|our|mein|meine|mon|ma|mi) (?:{WHO})\b)"
_TWO = re.compile(rf"[A-ZÀ-ÖØ-Þ][a-zß-ÿ’'-]+[ ](?:[A-ZÀ-Þ]\.[ ])?(?:{_PARTICLES}[ ])?[A-ZÀ-ÖØ-Þ][a-zß-ÿ]")
_CAP_BEFORE = re.compile(r"[A-ZÀ-ÖØ-Þ][\w’'-]*[ ]$")

#: What a text must hold for any of the detectors to fire; RE2 patterns over whole columns. Texts
#: that normalise() may change pass whole (last two), others hold what a detector asks for.
_NEEDED = (
    r"[@＠]|&#64;|&commat;|\sAT\s|[\[({<]\s*(?:at|AT|arroba)\s*[\])}>]|\bdot\b",
    r"[0-9]{6}|[0-9][ ./()-]{1,2}[0-9]|[0-9]{2}-[0-9]|[A-Z]{2,3} ?[0-9]{5}|[A-Z][0-9]{6}|[0-9](?:[A-Z .-]*[0-9]){4}",
    r"(?i)\b(?:st|street|road|rd|lane|ln|avenue|ave|drive|dr|terrace|close|crescent|court|ct|way"
    r"|place|square|gardens|grove|boulevard|blvd|mews|rue|bd|chemin|impasse|quai|calle|avenida|avda"
    r"|plaza|paseo|camino|ronda)\b|allée|C/\s|Travesía|(?:straße|strasse|str\.|gasse|weg|platz|allee"
    r"|ufer|damm)\s[0-9]",
    rf"(?i)\b(?:{_DIGIT})[\s,;.-]{{1,2}}(?:{_DIGIT})[\s,;.-]{{1,2}}(?:{_DIGIT})[\s,;.-]",
    rf"\b(?:{'|'.join(GIVEN)})\b|\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señora?"
    r"|Sra?|Sir|Doña)\b",
    rf"{_NEAR_BEFORE}[A-Z][a-z'-]+ (?:[A-Z]\. )?(?:{_PARTICLES} )?[A-Z][a-z]|[A-Z][a-z'-]+ (?:[A-Z]\. )?(?:{_PARTICLES} )?[A-Z][a-z'-]+{_NEAR_AFTER}",
    r"[^\x00-\x7f]|[\x0b\x1c-\x1f]",
    r"</?[a-zA-Z]|&(?:amp;)?(?:lt|#60);|&(?:#46|period|nbsp);|\\(?:textbf|textit|emph|underline|text)\{|\}|\*|~~|''|`|>!|!<|\[\[|\]\]|\]\(https?:",
)


def _single(ch: str) -> str:
    if ch in LOOK_ALIKES:
        return LOOK_ALIKES[ch]
    cat = unicodedata.category(ch)
    if cat == "Cf":
        return ""
    if cat == "Zs":
        return " "
    if cat == "Nd":
        return str(unicodedata.digit(ch))
    if unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>", "<font>")):
        return unicodedata.normalize("NFKC", ch)
    return {"–": "-", "—": "-", "‐": "-", "‑": "-", "−": "-", "’": "'"}.get(ch, ch)


class Traced:
    """A text with, for every character, the span of the source it stands for."""

    def __init__(self, source: str) -> None:
        self.text = source
        self.start = list(range(len(source)))
        self.end = list(range(1, len(source) + 1))

    def rewrite(self, pattern: re.Pattern, to) -> None:
        """Replace matches by ``to(match)``; the new characters stand for the whole match."""
        parts, start, end, last = [], [], [], 0
        for m in pattern.finditer(self.text):
            a, b = m.span()
            if a == b:
                continue
            new = to(m)
            parts += (self.text[last:a], new)
            start += self.start[last:a] + [self.start[a]] * len(new)
            end += self.end[last:a] + [self.end[b - 1]] * len(new)
            last = b
        if last:
            self.text = "".join(parts) + self.text[last:]
            self.start = start + self.start[last:]
            self.end = end + self.end[last:]

    def source_span(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


_ODD = re.compile(r"[^\x00-\x7f]")


def _digits(m: re.Match) -> str:
    """555, 0124 -> 555-0124: separators other than a space become hyphens."""
    said = _SPELLED_ONE.sub(lambda d: SPELLED[d[0].lower()], m[0])
    return re.sub(r"\s+", "", re.sub(r"[,;.\-]\s*", "-", said))


def normalise(source: str) -> Traced:
    """The traced text all detectors run on."""
    t = Traced(source)
    if not source.isascii():
        t.rewrite(_ODD, lambda m: _single(m[0]))
    if "&" in t.text:
        t.rewrite(_ENTITY_RE, lambda m: _ENTITY[m[0]])
    if re.search(r"[<\\*~'`\[&>}]", t.text):
        t.rewrite(_MARKUP, lambda m: "")
    t.rewrite(_SPELLED_RUN, _digits)
    return t


def find(source: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of what is found, in order, without overlaps; code point offsets."""
    t = normalise(source)
    text, taken, out = t.text, [], []

    def take(a: int, b: int, kind: str) -> None:
        if all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
            out.append((*t.source_span(a, b), kind))

    for m in EMAIL.finditer(text):
        if not _FILE.search(m[0]):
            take(*m.span(), "email")
    for m in ID_NUMBER.finditer(text):
        k = m.lastindex
        take(*m.span(k), "id_number")
    for m in PHONE.finditer(text):
        if 7 <= sum(c.isdigit() for c in m[0]) <= 15:
            take(*m.span(), "phone")
    for m in ADDRESS.finditer(text):
        take(*m.span(), "address")
    for m in NAME.finditer(text):
        take(*m.span(), "name")
    if _TWO.search(text):
        for m in STRANGER.finditer(text):
            a, b = m.span(m.lastindex)
            if m.lastindex == 1 or not _CAP_BEFORE.search(text, max(0, a - 40), a):
                take(a, b, "name")
    return sorted(out)


def redact(source: str, spans: list[tuple[int, int, str]]) -> str:
    """The source with each span replaced by the placeholder of its type."""
    parts, last = [], 0
    for a, b, kind in spans:
        parts += (source[last:a], f"[{kind.upper()}]")
        last = b
    return "".join(parts) + source[last:]


def _candidates(column: pa.Array) -> pa.Array:
    hit = None
    for pattern in _NEEDED:
        this = pc.match_substring_regex(column, pattern)
        hit = this if hit is None else pc.or_(hit, this)
    return pc.fill_null(hit, False)


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string())])
SCHEMA = "k string, text string, spans array<struct<start:int,end:int,type:string>>"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        new, spans = texts.to_pylist(), [()] * batch.num_rows
        for k in pc.indices_nonzero(_candidates(texts)).to_pylist():
            found = find(new[k])
            if found:
                spans[k] = [dict(zip(("start", "end", "type"), s)) for s in found]
                new[k] = redact(new[k], found)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(new, pa.string()), pa.array(spans, pa.list_(_SPAN))],
            ["k", "text", "spans"],
        )


def _spans_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, at, kinds = batch.column(1), [], []
        rows = pc.indices_nonzero(_candidates(texts))
        for k, text in zip(rows.to_pylist(), texts.take(rows).to_pylist()):
            for kind in {s[2] for s in find(text)}:
                at.append(k)
                kinds.append(kind)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string())], ["k", "type"]
        )


def replace_pii(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key as string, text, spans): the text with placeholders, and where they stood.

    Spans are code point offsets into the source. Null texts stay null and empty ones empty, with
    no spans; everything outside the spans is unchanged, character for character. Repeated rows
    come out repeated; extra columns are dropped, whatever their names; whole texts are read.
    """
    rows = df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("text"))
    return rows.mapInArrow(_run, SCHEMA).withColumnRenamed("k", key)


def pii_types(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key as string, type): the types found in each row, by the same detectors."""
    rows = df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("text"))
    rows = rows.filter(F.col("text").isNotNull())
    return rows.mapInArrow(_spans_only, "k string, type string").withColumnRenamed("k", key)
