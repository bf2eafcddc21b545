"""Texts cut off by length limits or in transfer.

Candidates are texts that do not end in closing punctuation. Whether one is cut is read off the
corpus: how often its last word occurs whole, how many words continue it (the weight of its node
in the trie of the corpus vocabulary), whether its last words end sentences elsewhere or always
go on, and whether its length is one at which the texts of its source pile up. Trie nodes and
word sequences are counted over all texts, but only those that some candidate asks for.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.session import cut

#: Longest word sequence that is looked up, and the occurrences it must have to decide.
ORDER, ENOUGH = 6, 4
#: Bits for each sequence asked for, and the most bits (16 MB), of the filter that keeps sequences
#: nobody asks for out of the shuffle. It changes no result: a full filter lets more of them through.
BITS_EACH, MOST_BITS = 16, 1 << 27
#: Parts into which the texts of one ending are split in joins.
SALTS = 8
#: An ending is casual if texts end in it this often, and this many times as often as chance cuts.
CASUAL, CASUAL_LIFT = 3, 3.0
#: A length is a limit if it has so many times as many texts of its source as the lengths next to
#: it, and more than chance gives them: by so many standard deviations of a Poisson count.
SPIKE_LIFT, SPIKE_SIGMA = 5.0, 4.0
#: Occurrences of the words before the last one that tell whether the last one may follow whole.
CONTEXT = 20

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+")
_END = re.compile(r"[.!?…:;。]|\n")
_COMPLETE = re.compile(r"(?:[.!?][\"'”’)\]*_~`]*|https?://\S+|[)\]}>\"”`*|])$")
_MARK = re.compile(r"\s*(?:\[(?:…|\.\.\.)\]|\((?:…|\.\.\.)\)|…|\.\.\.)$")
_EMOJI = re.compile(r"[\s☀-➿️‍\U0001F000-\U0001FAFF]+$")
_BROKEN = re.compile("�+$")

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+|[.!?…:;。\n\0]")
#: Hashes of tokens that are no words: the end of a sentence, the end of a text.
_STOP, _BREAK = 0, 1


class _Hashes(dict):
    """Token -> hash; numbers count as one word."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        if token == "\0":
            h = _BREAK
        elif len(token) == 1 and _END.match(token):
            h = _STOP
        else:
            h = xxhash.xxh64_intdigest("0" if token[0].isdigit() else token) >> 1
        self[token] = h
        return h


_hashes = _Hashes()


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word) >> 1


_START = _hash("^")


def words(text: str) -> tuple[list[str], list[str]]:
    """(words in lower case, numbers as 0; what stands after each word: w goes on, e ends)."""
    out, after, last = [], [], 0
    for m in _WORD.finditer(text):
        if out:
            after.append("e" if _END.search(text, last, m.start()) else "w")
        w = m[0]
        out.append("0" if w[0].isdigit() else w.lower())
        last = m.end()
    if out:
        after.append("e" if _END.search(text, last) else "x")
    return out, after


def ending(text: str) -> tuple[str, str]:
    """(text without its trailing mark, kind): kind is empty for a complete text.

    plain: no closing sign; mark: trailing dots; explicit: bracketed dots; broken: a split
    character; comma: an open comma.
    """
    t = text.rstrip()
    if _BROKEN.search(t):
        return _BROKEN.sub("", t), "broken"
    m = _MARK.search(t)
    if m:
        return t[: m.start()], "explicit" if m[0].strip()[0] in "[(" else "mark"
    if not t or _COMPLETE.search(t) or _EMOJI.search(t):
        return t, ""
    if t[-1] in ",;–—-":
        return t, "comma"
    return t, "plain"


def _sequences(hashes: np.ndarray, opens: np.ndarray) -> list[np.ndarray]:
    """For each order the hash of the words up to each place, 0 where a sentence begins inside.

    ``opens`` is true at words that begin a sentence; a sequence may begin with the start sign.
    """
    n = len(hashes)
    out, run, alive = [], hashes.copy(), np.ones(n, bool)
    began = np.zeros(n, bool)
    for k in range(1, ORDER + 1):
        out.append(np.where(alive, run, 0))
        start = np.concatenate([np.ones(min(k - 1, n), bool), opens[: max(0, n - k + 1)]])[:n]
        alive = alive & ~began
        began = start
        prev = np.full(n, _START, np.uint64)
        if n > k:
            prev[k:] = hashes[:-k]
        prev[began] = _START
        run = run * np.uint64(0x9E3779B97F4A7C15) + prev + np.uint64(k)
    return out


def _encode(text: str) -> tuple[list[str], list[str], list[np.ndarray]]:
    w, after = words(text)
    hashes = np.array([_hash(x) for x in w], np.uint64)
    opens = np.array([True] + [a == "e" for a in after[:-1]], bool)[: len(w)]
    return w, after, _sequences(hashes, opens)


def _encode_all(texts: list[str]) -> tuple[Counter, np.ndarray, list[np.ndarray]]:
    """Of many texts at once: counts of words, which words end sentences, sequences by order.

    The last word of a text without an end sign tells nothing and is left out.
    """
    tokens = _TOKEN.findall("\0".join([t.replace("\0", " ") for t in texts]).lower() + "\0")
    h = np.array([_hashes[t] for t in tokens], np.uint64)
    word = h > _BREAK
    opens = np.concatenate([[True], ~word[:-1]])
    nxt = np.concatenate([h[1:], [_BREAK]])
    kept = word & (nxt != _BREAK)
    counts = Counter(t for t, k in zip(tokens, kept.tolist()) if k)
    # the words left out come last in their texts, so no other word's sequence holds them
    return counts, nxt[kept] == _STOP, [s[kept[word]] for s in _sequences(h[word], opens[word])]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, source, kind, n_chars, order of the whole last sentence, prefix hash, sequence hashes,
    hashes of the sequences that lead up to the last word).
    """
    for batch in batches:
        rows = []
        for k, source, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
            bare, kind = ending(text)
            if not kind:
                continue
            w, after, seqs = _encode(bare)
            last = w[-1] if w else ""
            lead = next((j for j, a in enumerate(reversed(after[:-1])) if a == "e"), len(after) - 1) + 2
            own = [int(s[-1].astype(np.int64)) for s in seqs] if w else []
            # of order 0 nothing leads up; nothing does across the beginning of a sentence either
            before = [0] + [int(s[-2].astype(np.int64)) for s in seqs[:-1]] if len(w) > 1 and after[-2] == "w" else [0] * len(own)
            rows.append((k, source, kind, len(text), lead, _hash("p:" + last), own, before))
        cols = list(zip(*rows)) if rows else [[]] * 8
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], list("ksgndphb"))


def _filter(asked: DataFrame) -> tuple[np.ndarray, int]:
    """(filter, bits) of the hashes in ``asked``; its words are put together by the executors."""
    n = asked.agg(F.approx_count_distinct("h")).first()[0]
    bits = min(MOST_BITS, 1 << max(16, (BITS_EACH * n - 1).bit_length()))
    at = F.pmod("h", F.lit(bits))
    words = asked.groupBy(F.shiftright(at, 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(h, 32) as int))")).alias("w"))
    t = words.toArrow()  # as many rows as the filter has words, 4 million at most
    out = np.zeros(bits >> 5, np.uint32)
    out[t["at"].to_numpy()] = t["w"].to_numpy().astype(np.uint32)
    return out, bits


def _passes(words: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(bits - 1)
    return (words[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0


def _counter(shared):
    """Counts of asked-for sequences (goes on, ends) and trie nodes over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, bits = shared.value
        seen: Counter = Counter()
        for batch in batches:
            words, ends, seqs = _encode_all(batch.column(0).to_pylist())
            seen.update(words)
            flat = np.concatenate(seqs)
            hit = (flat != 0) & _passes(asked, bits, flat)
            ends = np.tile(ends, ORDER)
            parts = []
            for kind, which in ((0, hit & ~ends), (1, hit & ends)):
                h, n = np.unique(flat[which], return_counts=True)
                parts.append((h.astype(np.int64), n, kind))
            parts.append((np.array([-1]), np.array([sum(words.values())]), 2))
            yield _counts(parts)
        nodes: Counter = Counter()
        for word, n in seen.items():
            if not word[0].isdigit():
                for k in range(1, len(word)):
                    nodes[_hash("p:" + word[:k])] += n
        h = np.fromiter(nodes.keys(), np.uint64, len(nodes))
        hit = _passes(asked, bits, h)
        yield _counts([(h[hit].astype(np.int64), np.fromiter(nodes.values(), np.int64, len(nodes))[hit], 0)])

    return run


def _counts(parts: list[tuple[np.ndarray, np.ndarray, int]]) -> pa.RecordBatch:
    h = np.concatenate([p[0] for p in parts])
    n = np.concatenate([p[1] for p in parts])
    kind = np.concatenate([np.full(len(p[0]), p[2], np.int32) for p in parts])
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(kind, pa.int32()), pa.array(n, pa.int64())], ["h", "kind", "n"])


DECISION = "k string, truncated boolean, reason string"


def _decide(rate: float):
    def one(kind: str, spike: bool, lead: int, whole: int, node: int, seqs: list) -> tuple[bool, str]:
        """seqs: (goes on, ends, texts that end so, what leads up to it goes on) by order, from 1.

        lead: the order of the whole last sentence; node: how often words go on from the last one.
        """
        if kind in ("broken", "explicit"):
            return True, kind
        if not seqs:
            return False, "no word"
        cut_word = whole == 0 and node > 0
        for k, (on, end, final, before) in enumerate(seqs):
            if k and (cut_word or k + 1 != lead):
                continue
            # how often a cut could have left just this ending: wherever its first words stand
            known = max(on + end + (node if k < 2 else 0), before)
            if kind != "comma" and final >= CASUAL and final > CASUAL_LIFT * rate * (known + 1):
                return False, "casual"
        if whole == 0 or node > 50 * whole:
            if node:
                return True, "prefix"
            return spike, "unknown at a limit" if spike else "unknown"
        if kind == "comma":
            return True, "open comma"
        for on, end, _, before in reversed(seqs):
            if on + end >= ENOUGH:
                break
            if not on + end and before >= CONTEXT and node:
                return True, "prefix in its place"
        for on, end, _, _ in reversed(seqs):
            if on + end >= ENOUGH:
                share = end / (on + end)
                if 0.35 < share < 0.65:
                    return bool(spike or (share < 0.5 and kind != "mark")), "unclear"
                return share < 0.5, "goes on elsewhere" if share < 0.5 else "ends elsewhere"
        return spike, "rare at a limit" if spike else "rare"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, g, spike, lead, node, seqs in zip(*(batch.column(c).to_pylist() for c in range(6))):
                rows = [(s["went"], s["ended"], s["final"], s["before"]) for s in sorted(seqs or [], key=lambda s: s["o"])]
                whole = rows[0][0] + rows[0][1] if rows else 0
                out.append((k, *one(g, bool(spike), lead, whole, node or 0, rows)))
            cols = list(zip(*out)) if out else [[]] * 3
            types = [pa.string(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["k", "truncated", "reason"])

    return run


def detect(texts: DataFrame) -> DataFrame:
    """(k, truncated, reason) of the texts with an open end; all other texts are complete.

    texts: k (unique), source, text. Null and empty texts are no cases and have no row here; the
    source may be null. Counts cover all rows. An empty table gives an empty result.
    """
    spark = texts.sparkSession
    rows = texts.select("k", "source", "text").filter(F.length("text") > 0)
    schema = T.StructType.fromDDL("k string, s string, g string, n long, d long, p long, h array<long>, b array<long>")
    open_ends = cut(rows.mapInArrow(_candidates, schema), "open")
    asked = open_ends.select(F.explode(F.concat("h", "b", F.array("p"))).alias("h")).filter("h <> 0")
    shared = spark.sparkContext.broadcast(_filter(asked))
    counts = rows.select("text").mapInArrow(_counter(shared), "h long, kind int, n long")
    counts = cut(
        counts.groupBy("h").agg(
            F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(0)).alias("went"),
            F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("ended"),
            F.sum(F.when(F.col("kind") == 2, F.col("n")).otherwise(0)).alias("tokens"),
        ),
        "sequences",
    )
    tokens = counts.filter("h = -1").agg(F.sum("tokens")).collect()[0][0] or 1
    rate = open_ends.count() / tokens
    # what each sequence does elsewhere, in how many texts it stands at the open end, and how often
    # the words before its last one go on
    long = open_ends.select("k", F.posexplode(F.arrays_zip("h", "b")).alias("o", "x")).select("k", "o", "x.h", "x.b").filter("h <> 0")
    finals = long.groupBy("h", "b").agg(F.count("*").alias("final"))
    leading = counts.select(F.col("h").alias("b"), F.col("went").alias("before"))
    known = finals.join(counts, "h", "left").join(leading, "b", "left")
    nought = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    # many texts have one ending: it is looked up once, and its texts spread over salts
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    known = known.select("h", nought("went"), nought("ended"), "final", nought("before"), salts.alias("salt"))
    salted = long.select("k", "o", "h", F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int").alias("salt"))
    seqs = salted.join(known, ["h", "salt"]).groupBy("k").agg(F.collect_list(F.struct("o", "went", "ended", "final", "before")).alias("seqs"))
    nodes = counts.select(F.col("h").alias("p"), F.col("went").alias("node"))
    near = _limits(rows)
    joined = (
        open_ends.join(nodes, "p", "left").join(seqs, "k", "left")
        .join(near, [open_ends["s"].eqNullSafe(near["source"]), open_ends["n"] == near["limit"]], "left")
    )
    ready = joined.select("k", "g", F.col("limit").isNotNull().alias("spike"), "d", "node", "seqs")
    return ready.mapInArrow(_decide(rate), DECISION)


def _limits(rows: DataFrame) -> DataFrame:
    """(source, limit): lengths at which the texts of a source pile up."""
    sizes = rows.groupBy("source", F.length("text").alias("limit")).agg(F.count("*").alias("n"))
    around = sizes.select("source", "n", "limit", F.explode(F.sequence(F.col("limit") - 3, F.col("limit") + 3)).alias("at"))
    near = around.groupBy("source", "at").agg(
        F.sum(F.when(F.col("at") != F.col("limit"), F.col("n")).otherwise(0)).alias("beside"),
        F.sum(F.when(F.col("at") == F.col("limit"), F.col("n")).otherwise(0)).alias("n"),
    )
    usual = F.col("beside") / 6
    spikes = near.filter((F.col("n") >= SPIKE_LIFT * usual) & (F.col("n") >= usual + 1 + SPIKE_SIGMA * F.sqrt(usual + 1)))
    return spikes.select("source", F.col("at").alias("limit"))
