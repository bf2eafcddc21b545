"""Template residue, filler and error-page texts, found by character n-gram models.

Models of filler, notices (error pages, script and cookie notices) and unfilled templates start
from the seed texts below; the model of natural prose is counted over all texts. A likelihood
ratio is laid over every text in sliding windows; windows above a threshold are residue, and a
stretch of text (a sentence or line) is excluded where residue covers enough of it. One round of
self-training adds the stretches found to the residue models and takes them out of the model of
prose. All steps run on the bytes of Arrow batches with vectorised arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Seed texts: labelled examples written for this module.
FILLER = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et
dolore magna aliqua|ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex
ea commodo consequat|duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu
fugiat nulla pariatur|excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt
mollit anim id est laborum|lorem ipsum veniam esse velit tempor nulla|asdf asdf asdf|asdfasdf|qwerty
qwerty|test test test|test test please ignore|testing testing 0 0 0|this is a test post|foo bar baz|foo foo
bar|xxx placeholder xxx|placeholder text|placeholder|insert text here|your text here|your comment
here|your title goes here|title goes here|body goes here|text goes here|sample text|sample title|dummy
text|type your message|type here|write your comment|todo: write text|todo: fill in|todo|tbd|to be
written|fixme: add description|blah blah blah|xxxxx xxxxx|aaaa aaaa|abc abc abc|add content here|content
coming soon|description goes here|hier steht ein text|texto de ejemplo|votre texte ici|beispieltext|
"""
NOTICES = """
error 000: internal server error|error 000: not found|000 not found.|error 000: forbidden|000 internal server error|http 000|http error 000|http 000 not found|000
not found|000 forbidden|000 gone|000 bad gateway|000 service unavailable|000 gateway timeout|000 too many
requests|bad gateway|service unavailable (000)|gateway timeout (000)|not found (000)|forbidden|gone|bad
request|the gateway did not receive a timely response from the upstream server|upstream connect error or
disconnect/reset before headers. reset reason: connection failure|000 - internal server error - request
id 0000|error code: 0000|incident 0000|reference number 0000|ref: 0000|code 0000|page not found|the page
you requested could not be found|the page you requested could not be loaded. return to the home page|the
link you followed is broken or has expired. ask for a new one|this page is no longer available|the server
encountered an error and could not complete your request|the server is temporarily down for maintenance.
we will be back soon|site under maintenance. please try again later|oops! something went wrong. please
reload the page|something went wrong on our end. please refresh and try again|an unexpected error
occurred|failed to load comments|failed to fetch|unable to load reply. click here to try once more|could
not connect to the server|connection timed out|request timed out|connection reset by peer|connection
refused|access denied|you do not have permission to access this resource|access to this page was
refused|your session has expired. please log in and try again|session timed out after 00 minutes of
inactivity. please sign in to continue|you have been logged out|you have been blocked. contact the site
owner and send this number|sorry, you have been blocked|your request was blocked|request 0000 was
blocked|too many requests from this address. slow down and retry in 00 seconds|rate limit exceeded. try
again in 00 minutes|we could not verify that you are human. solve the puzzle and reload|please verify you
are a human|complete the captcha to continue|checking your browser before accessing the page. this may
take up to 0 seconds|please wait while we check your browser|please enable javascript to continue|you need
to enable javascript to run this app|this site requires javascript|this content requires javascript. your
browser has it switched off|javascript is disabled in your browser|please enable scripts and cookies to
continue|cookies are disabled. please allow them and refresh|you must allow cookies for this site|your
browser is not supported. please update it to read this page|if nothing happens, allow scripts for this
site|loading|loading comments|loading, please wait|please wait|undefined|undefined undefined|null|null null
null|nan|nan nan|none|[object object]|traceback: render() failed for widget, value is none at line
00|traceback (most recent call last)|uncaught typeerror: cannot read property of undefined|exception in
thread main|nullpointerexception at line 00|syntax error: unexpected token at line 00|fatal error: call to
undefined function on line 00|warning: undefined variable on line 00|<html><head><title>000 bad gateway</title>
</head><body><center><h0>000 bad gateway</h0></center><hr><center>nginx/0.00.0</center></body></html>|<h0>internal
server error</h0><p>request was blocked.</p>|<h0>forbidden</h0><p>request 0000 was denied.</p>|<noscript>you need
to enable javascript to run this app.</noscript>|<noscript>please allow scripts</noscript>|{"error": "not found",
"status": 000}|{"message": "internal server error", "id": "0000"}|{"error": "forbidden", "code": 000}|database
connection failed: too many connections|diese seite
benötigt javascript|bitte aktivieren sie javascript, um fortzufahren|zugriff verweigert. vorgang 0000|seite
nicht gefunden|interner serverfehler|dienst nicht verfügbar, bitte später erneut versuchen|ihre sitzung ist
abgelaufen|fehler 000: seite nicht gefunden|erreur 000 : page introuvable|accès refusé|veuillez activer
javascript pour afficher ce contenu|service indisponible, veuillez réessayer plus tard|votre session a
expiré|page introuvable|activa javascript para seguir leyendo|servicio no disponible, inténtalo de nuevo en 00
minutos|página no encontrada|acceso denegado|error 000: página no encontrada|su sesión ha caducado|
"""
#: Talk about such texts and the standing notes of bots, made up for this module as the seeds are:
#: counted to the model of prose.
MENTIONS = """
my browser shows a gateway error whenever the store is busy|did anybody else get logged out of the app last
night?|it says the page does not exist, although i bookmarked it|i had to switch on scripts for the booking
site before it worked|their cookie banner covers half of the screen|the designer left latin dummy copy on the
leaflet|we used lorem ipsum on the poster until the real words arrived|how do i make the mail merge put in the
first name?|the variable in braces is swapped for the name of the customer|my script printed null so i added a
check|after the update the log is full of timeouts|support told me that the service was unavailable because of
maintenance|solving a captcha every time i log in is tiring|i typed asdf to test the keyboard|what does this
error code mean on the display?|the machine shows an error and stops|the form keeps asking me to enable
javascript, so i gave up|why does the shop say access denied when i am signed in?|a friend got a server error and
waited an hour|the label still had a placeholder where the name should be|the template fills in the date by
itself|can someone explain the not found message in the manual?|welcome to the group, be kind and search before
you ask|this is an automatic message, write to the team with questions|somebody from the team will read your
question within 00 hours|busy threads are sorted by the newest reply|your post is number 00 in the queue for
review|weekly questions belong in the pinned post|please read the rules before you post here|i am an automated
account and cannot answer|
"""
#: Names and signs that unfilled templates are written with.
NAMES = (
    "name first_name last_name user username title date day time city country email company order_id "
    "product url link author topic body subject message text price address phone number count"
).split()
STYLES = (
    "{{%s}}|{{ %s }}|{%s}|${%s}|<%%= %s %%>|<<%s>>|#{%s}|%%(%s)s|%%%s%%|<your %s>|[your %s]|"
    "{{{%s}}}|@@%s@@|<%s>|{%%= %s %%}"
).split("|")
LOUD = ("[%s]", "[[%s]]", "[INSERT %s HERE]", "__%s__", "<<%s>>", "{%s}", "<%s HERE>", "[%s GOES HERE]")
CARRIERS = (
    "%s", "Dear %s,", "Hi %s, thanks for your message about %s.", "Hello %s!", "Welcome to %s!",
    "Posted by %s on %s", "Re: %s", "Your %s is ready.", "%s replied to %s:", "About %s", "Summary: %s",
    "Hola %s, gracias por escribir sobre %s.", "Hallo %s, danke für %s.", "Bonjour %s, merci pour %s.",
)

BITS = 20
#: Frequency below which an n-gram tells nothing.
FLOOR = 1e-6
#: Share of the model of prose that the talk about residue makes up.
MENTION_SHARE = 0.05
#: Length of the sliding window, and the mean log ratio above which it is residue.
WINDOW, WINDOW_MIN = 10, 0.7
#: Stretches that train the second round: share of residue and mean log ratio at least.
SURE_COVER, SURE_MEAN = 0.6, 2.2
#: Share of a stretch that residue must cover, and the least number of residue characters.
COVER, COVER_CHARS = 0.5, 5
#: Mean log ratio of a stretch below which it stays.
MEAN = 1.8
CLASSES = ("filler", "notice", "template", "shape")

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_FOLD[[9, 11, 12, 13]] = 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = _LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123] = _KIND[128:] = 97
_KIND[65:91] = 65
_KIND[48:58] = 48
_KIND[[9, 10, 11, 12, 13]] = 32


#: Quoted code, LaTeX commands with their argument and wiki links with a text are no residue.
_ASIDE = (
    r"`[^`\n]*`|\\[a-zA-Z]+\{[^{}\n]*\}|[_^]\{[^{}\n]*\}|\[\[[^\[\]|\n]*\|[^\[\]\n]*\]\]"
    r"|\{\{[^{}|\n]*\|[^{}\n]*\}\}"
)


def _has(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SIGN = _has("{}[]<>%$#@_")
_END, _CLOSE, _SPACE = _has(".!?:"), _has("})]>%_"), _has(" \t\n")


def _grams(b: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all byte n-grams, one per start (the last n-1 starts repeat the last hash)."""
    h = b.astype(np.uint32)
    out = h[: max(0, len(h) - n + 1)].copy()
    for k in range(1, n):
        out = out * np.uint32(0x01000193) + h[k : k + len(out)] + np.uint32(1)
    out = (out * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    return np.concatenate([out, np.zeros(len(b) - len(out), np.uint32)])


def _shape(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with runs of one kind of letter or digit collapsed, index of each byte's run)."""
    kind = _KIND[b]
    run = (kind == 97) | (kind == 65) | (kind == 48)
    inner = _has("_.")[b]
    if len(b) > 2:
        inner[1:-1] &= run[:-2] & run[2:]
        inner[[0, -1]] = False
        kind[1:-1][inner[1:-1]] = kind[:-2][inner[1:-1]]
        run |= inner
    same = np.zeros(len(b), bool)
    same[1:] = (kind[1:] == kind[:-1]) & run[1:] & run[:-1]
    return kind[~same], np.cumsum(~same) - 1


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all texts as bytes, each ended by a line end; start of each text, and the end)."""
    quoted = pc.replace_substring_regex(column.fill_null(""), _ASIDE, "")
    ended = pc.binary_join_element_wise(quoted, pa.scalar(""), "\n").cast(pa.large_binary())
    _, offsets, data = ended.buffers()
    at = np.frombuffer(offsets, np.int64)[ended.offset : ended.offset + len(ended) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _stretches(b: np.ndarray) -> np.ndarray:
    """Starts of the stretches: lines, sentences, and what follows a closing sign and a capital."""
    nxt = np.append(b[1:], 10)
    nx2 = np.append(b[2:], [10, 10])[: len(b)]
    prev = np.concatenate([[10], b[:-1]])
    cap = _SPACE[nxt] & _UPPER[nx2]
    cut = (b == 10) | (_END[b] & _SPACE[nxt]) | (_CLOSE[b] & cap)
    cut |= (b == 115) & (prev == 41) & cap
    return np.concatenate([[0], np.flatnonzero(cut[:-1]) + 1])


def _count(b: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts of letters and of shapes, of the bytes in ``keep`` if given."""
    g = _grams(_FOLD[b], 5)
    s, at = _shape(b)
    gs = _grams(s, 4)[at]
    if keep is not None:
        g, gs = g[keep], gs[keep]
    return np.bincount(g, minlength=1 << BITS), np.bincount(gs, minlength=1 << BITS)


class Model:
    """Log-likelihood ratios of n-grams: residue of each class against prose."""

    def __init__(self, residue: list, prose: list) -> None:
        self.ratio = []
        for c, r in zip(CLASSES, residue):
            p = prose[c == "shape"]
            top = r / max(1e-9, r.sum()) + FLOOR
            ratio = np.log(top / (p / max(1e-9, p.sum()) + FLOOR))
            self.ratio.append(np.clip(ratio, -4, 6).astype(np.float32))

    def score(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts of the stretches, share of residue, class, mean ratio) of a byte buffer."""
        starts = _stretches(b)
        g = _grams(_FOLD[b], 5)
        s, at = _shape(b)
        broken = np.zeros(len(b), bool)
        for k in range(5):
            broken[: len(b) - k] |= b[k:] == 10
        masks, best = [], None
        for c, ratio in zip(CLASSES, self.ratio):
            if c == "shape":  # only shapes that hold a sign of a placeholder tell anything
                sign = _SIGN[s]
                near = sign.copy()
                for k in range(1, 4):
                    near[: len(s) - k] |= sign[k:]
                r = np.where(near, ratio[_grams(s, 4)], np.float32(0))[at]
            else:
                r = ratio[g]
            r[broken] = 0  # across line ends
            total = np.concatenate([[0], np.cumsum(r, dtype=np.float64)])
            w = min(WINDOW, len(r))
            hot = np.zeros(len(r) + 1, np.int32)
            mean = (total[w:] - total[:-w]) / w
            first = np.flatnonzero(mean > WINDOW_MIN)
            np.add.at(hot, first, 1)
            np.add.at(hot, first + w, -1)
            masks.append(np.cumsum(hot[:-1]) > 0)
            best = r if best is None else np.maximum(best, r)
        masks[2] |= masks[3]
        ink = ~_SPACE[b]
        length = np.add.reduceat(ink.astype(np.int32), starts)
        each = np.stack([np.add.reduceat((m & ink).astype(np.int32), starts) for m in masks[:3]])
        union = np.add.reduceat(((masks[0] | masks[1] | masks[2]) & ink).astype(np.int32), starts)
        share = np.where(union >= np.minimum(COVER_CHARS, length), union / np.maximum(length, 1), 0)
        mean = np.add.reduceat(best.astype(np.float64), starts) / np.diff(np.append(starts, len(b)))
        return starts, np.where(length > 0, share, 0), each.argmax(0), mean


def _seed_counts() -> list[np.ndarray]:
    def lines(text: str) -> list[str]:
        return [" ".join(x.split()) for x in text.split("|") if x.strip()]

    fills = [s.replace("%s", n).replace("%%", "%") for s in STYLES for n in NAMES]
    fills += [s.replace("%s", n.upper().replace("_", " ")) for s in LOUD for n in NAMES]
    templates = []
    for k, fill in enumerate(fills):
        carrier = CARRIERS[k % len(CARRIERS)]
        templates.append(carrier.replace("%s", fill, 1).replace("%s", fills[(k * 7) % len(fills)]))
    out = []
    for text in (lines(FILLER), lines(NOTICES), templates):
        b = np.frombuffer(("\n".join(text) + "\n").encode(), np.uint8)
        out.append(_count(b))
    bare = np.frombuffer(("\n".join(fills) + "\n").encode(), np.uint8)
    return [out[0][0], out[1][0], out[2][0], _count(bare)[1]]


def _mention_counts() -> list[np.ndarray]:
    text = "\n".join(" ".join(x.split()) for x in MENTIONS.split("|") if x.strip()) + "\n"
    return list(_count(np.frombuffer(text.encode(), np.uint8)))


def _emit(tables: list[np.ndarray]) -> pa.RecordBatch:
    rows = [np.flatnonzero(t) for t in tables]
    which = np.repeat(np.arange(len(tables), dtype=np.int32), [len(r) for r in rows])
    bucket = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
    n = np.concatenate([t[r] for t, r in zip(tables, rows)]).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(which), pa.array(bucket), pa.array(n)], ["w", "b", "n"])


def _sum_tables(parts: DataFrame, count: int) -> list[np.ndarray]:
    """Add up the count tables of all tasks; at most ``count`` * 2**BITS rows come back."""
    done = parts.groupBy("w", "b").agg(F.sum("n").alias("n")).toArrow()
    out = [np.zeros(1 << BITS, np.int64) for _ in range(count)]
    w, b, n = (done.column(k).to_numpy() for k in range(3))
    for k in range(count):
        out[k][b[w == k]] = n[w == k]
    return out


def fit(texts: DataFrame, column: str) -> Model:
    """Fit the models over all rows of ``texts``.

    Counts cover every text in whole; nulls and empty texts add nothing. Over an empty table the
    models are those of the seed texts.
    """
    slim = texts.select(F.col(column).alias("t")).filter(F.length("t") > 0)

    def count_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                both = _count(_bytes(batch.column(0))[0])
                total = both if total is None else (total[0] + both[0], total[1] + both[1])
        if total is not None:
            yield _emit(list(total))

    schema = "w int, b int, n long"
    everything = _sum_tables(slim.mapInArrow(count_all, schema), 2)
    seeds, mentions = _seed_counts(), _mention_counts()
    # talk about residue is rare in any corpus but must be known to the model of prose
    total = []
    for m, t in zip(mentions, everything):
        total.append(t * (1 - MENTION_SHARE) / max(1, t.sum()) + m * MENTION_SHARE / m.sum())
    first = slim.sparkSession.sparkContext.broadcast(Model(seeds, total))

    def count_residue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(1 << BITS, np.int64) for _ in range(5)]
        for batch in batches:
            if not batch.num_rows:
                continue
            b, _ = _bytes(batch.column(0))
            starts, share, kind, mean = first.value.score(b)
            size = np.diff(np.append(starts, len(b)))
            hit = (share >= SURE_COVER) & (mean >= SURE_MEAN)
            for k in range(3):
                keep = np.repeat(hit & (kind == k), size)
                if keep.any():
                    letters, shapes = _count(b, keep)
                    sums[k] += letters
                    sums[3 + (k != 2)] += shapes
        yield _emit(sums)

    found = _sum_tables(slim.mapInArrow(count_residue, schema), 5)
    first.unpersist()
    # seeds and found stretches make up half of each class, whatever their lengths
    residue = [s / s.sum() + (f / f.sum() if f.sum() else 0) for s, f in zip(seeds, found[:4])]
    gone = [found[0] + found[1] + found[2], found[3] + found[4]]
    prose = []
    for t, g, e in zip(total, gone, everything):
        prose.append(np.maximum(0, t - g * (1 - MENTION_SHARE) / max(1, e.sum())))
    return Model(residue, prose)


def mark(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key as string, residue, kind, ratio): share of the text in excluded stretches, their class
    and the highest mean log ratio of one.

    ``residue`` is 0 and ``kind`` null where nothing is excluded, as for null, empty and blank
    texts. Repeated rows come out repeated; extra columns are dropped, whatever their names.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            b, at = _bytes(batch.column(1))
            starts, share, kind, mean = shared.value.score(b)
            row = np.searchsorted(at, starts, "right") - 1
            hit = (share >= COVER) & (mean >= MEAN)
            size = np.diff(np.append(starts, len(b)))
            gone = np.bincount(row[hit], size[hit], n)
            kinds = np.full(n, -1)
            order = np.flatnonzero(hit)[np.argsort(size[hit], kind="stable")]
            kinds[row[order]] = kind[order]  # the longest stretch decides
            names = np.array([*CLASSES[:3], None], object)[kinds]
            ratio = np.zeros(n)
            np.maximum.at(ratio, row[hit], mean[hit])
            whole = np.maximum(np.diff(at), 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.minimum(gone / whole, 1.0)), pa.array(names, pa.string()), pa.array(ratio)],
                ["k", "residue", "kind", "ratio"],
            )

    rows = df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "k string, residue double, kind string, ratio double").withColumnRenamed("k", key)
