"""Scores for abusive, hateful and sexual content from the nearest labelled examples.

Labelled texts are cut into stretches (sentences, windows of long ones) and undisguised. Their
TF-IDF vectors lie in an inverted index: the postings of a term name the blocks of documents that
hold it, each with the term's largest weight there, which together bound every cosine in a block.
Blocks whose bound falls short of the radius are skipped. A query visits the others in descending
order of the bound and stops when no block can beat its k-th neighbour, so the neighbours are
exact. Neighbours vote with the square of their cosine; votes are calibrated on left-out labels.
"""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.visual import INVISIBLE, LOOK_ALIKES

#: Labelled records the index is fitted on at most, taken in the order of a hash of their ids.
MAX_LABELLED = 20_000
#: Neighbours that vote, and the least cosine of a neighbour.
NEIGHBOURS, RADIUS = 10, 0.33
#: Cosine of the nearest case from which a stretch can score at all: any neighbour counts.
CASE_RADIUS = RADIUS
#: Mean rating from which a labelled record counts as a case.
CASE_RATING = 1.5
BLOCK = 64
#: Docs per block in the bound over the cases alone, which nearly all harmless stretches fail.
CASE_BLOCK = 4
#: Tokens of a window in stretches of more than WINDOW_FROM tokens.
WINDOW, WINDOW_FROM = 12, 17
#: Share of votes, drawn towards the share of cases, from which a stretch of a case is to blame.
BLAME_FROM, SURE_FROM = 0.3, 0.55
#: Weight of a vote for "harmless" that every stretch gets.
DAMPING = 0.15

_SPLIT = re.compile(r"(?<=[.!?…])\s+|\n+|\s{3,}")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
_TAG = re.compile(r"</?[a-z][^<>]*>|&(?:amp;)?[a-z#0-9]+;|\\[a-z]+\{|https?://\S+|[`~{}\[\]|]|\*\*|'''?")
_MARKED = re.compile(r"[<&\\`~{}\[\]|]|://|\*\*|''")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_] ){2,}[^\W\d_](?!\w)")
_DOTTED = re.compile(r"(?<=[^\W\d_])[.·_-](?=[^\W\d_])")
_LEET = re.compile(r"\w*[0-9@$!]\w*[^\W\d_]\w*|\w*[^\W\d_]\w*[0-9@$]\w*[^\W\d_]\w*")
_REPEAT = re.compile(r"([^\W\d_])\1{2,}")
_STAR = re.compile(r"(?<!\w)[^\W\d_]+\*+[^\W\d_]+|(?<!\w)\*[^\W\d_]{2,}(?<!\*)(?![\w*])|[^\W\d_]{2,}\*(?!\S)")
_SUSPECT = re.compile(r"[0-9@$]\w*[^\W\d_]|[^\W\d_]\*|\*[^\W\d_]|([^\W\d_])\1\1|\b\w \w \w\b|\w[.·_-]\w")
# Digits and signs written for letters.
LEET = str.maketrans({"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t"})


_LOOKS = str.maketrans(LOOK_ALIKES) | dict.fromkeys(INVISIBLE)


def _plain(text: str) -> str:
    """Lower case, without markup, look-alike letters as Latin ones."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_LOOKS)
    text = text.lower()
    return _TAG.sub(" ", text) if _MARKED.search(text) else text


def undisguise(text: str, starred: dict[str, str]) -> str:
    """Spaced, dotted, repeated, starred and digit-for-letter spellings back to plain words."""
    if not _SUSPECT.search(text):
        return text
    text = _SPACED.sub(lambda m: m[0].replace(" ", ""), text)
    text = _DOTTED.sub("", text)
    text = _LEET.sub(lambda m: m[0].translate(LEET) if not m[0].isdigit() else m[0], text)
    text = _REPEAT.sub(r"\1", text)
    if "*" in text:
        text = _STAR.sub(lambda m: starred.get(m[0], m[0].replace("*", "")), text)
    return text


def stretches(text: str) -> list[str]:
    """The sentences and lines of a text, without blank ones."""
    return [s for s in _SPLIT.split(text) if s and not s.isspace()]


def windows(tokens: list[str]) -> list[list[str]]:
    """The whole stretch and, if it is long, overlapping windows of it."""
    out = [tokens]
    if len(tokens) > WINDOW_FROM:
        last = len(tokens) - WINDOW
        out += [tokens[a : a + WINDOW] for a in [*range(0, last, WINDOW // 2), last]]
    return out


def _ranges(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers from each first to its end, one range after the other."""
    length = end - first
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    step = np.ones(total, np.int64)
    full = length > 0
    first, length = first[full], length[full]
    starts = np.cumsum(length)[:-1]
    step[0] = first[0]
    step[starts] = first[1:] - (first[:-1] + length[:-1] - 1)
    return np.cumsum(step)


class Postings:
    """Term -> the blocks of docs that hold it, each with the term's largest weight there.

    Blocks are ``size`` docs of the first ``n``; memory goes with what the docs hold, not with
    vocabulary times blocks.
    """

    def __init__(self, at: np.ndarray, ids: np.ndarray, weights: np.ndarray, n: int, size: int, terms: int) -> None:
        self.n, self.size, self.blocks = n, size, -(-n // size)
        part = slice(0, at[n])
        block = np.repeat(np.arange(n) // size, np.diff(at[: n + 1]))
        term, w = ids[part].astype(np.int64), weights[part]
        order = np.lexsort((block, term))
        key = term[order] * max(self.blocks, 1) + block[order]
        first = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.zeros(0, np.int64)
        self.max = np.maximum.reduceat(w[order], first) if len(first) else np.zeros(0, np.float32)
        self.block = block[order][first].astype(np.int32)
        # the id past the vocabulary stands for unknown terms, which no doc holds
        self.ptr = np.searchsorted(term[order][first], np.arange(terms + 2))
        self.top = np.zeros(terms + 1, np.float32)
        held = np.flatnonzero(np.diff(self.ptr))
        if len(held):
            self.top[held] = np.maximum.reduceat(self.max, self.ptr[held])

    def bounds(self, ids: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The largest cosine that any doc of each block can have with a query."""
        out = np.zeros(self.blocks, np.float32)
        for x, a, b in zip(w, self.ptr[ids].tolist(), self.ptr[ids + 1].tolist()):
            out[self.block[a:b]] += x * self.max[a:b]  # a term names a block once
        return out

    def likely(self, ids: np.ndarray, w: np.ndarray, terms: int = 4, n: int = 2) -> np.ndarray:
        """A few blocks in which the terms of a query that can add most come together."""
        most = w * self.top[ids]
        order = np.argsort(-most)[:terms]
        first = ids[order[0]]
        blocks = self.block[self.ptr[first] : self.ptr[first + 1]]
        total = w[order[0]] * self.max[self.ptr[first] : self.ptr[first + 1]]
        for k in order[1:]:
            a, b = self.ptr[ids[k]], self.ptr[ids[k] + 1]
            if b > a:
                at = np.minimum(np.searchsorted(self.block[a:b], blocks), b - a - 1)
                total = total + np.where(self.block[a:b][at] == blocks, w[k] * self.max[a:b][at], 0)
        return blocks[np.argsort(-total)[:n]]

    def candidates(self, at: np.ndarray, ids: np.ndarray, w: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, block), in this order: the blocks whose bound for a query is at least ``least``.

        Queries whose terms cannot make it up in any block are not looked up.
        """
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        able = np.bincount(row, w * self.top[ids], len(at) - 1)[row] >= least
        row, ids, w = row[able], ids[able], w[able]
        first, end = self.ptr[ids], self.ptr[ids + 1]
        part = _ranges(first, end)
        key = np.repeat(row * self.blocks, end - first) + self.block[part]
        total = np.bincount(key, np.repeat(w, end - first) * self.max[part], (len(at) - 1) * self.blocks)
        hit = np.flatnonzero(total >= least)
        return hit // self.blocks, hit % self.blocks


class Index:
    """Labelled stretches, their vectors and the postings of their terms."""

    def __init__(self, docs: list[tuple[str, ...]], cases: np.ndarray, records: list[int]) -> None:
        """docs: token tuples, distinct; cases: share of case votes; records: records per doc."""
        df = Counter(t for d in docs for t in set(d))
        n = len(docs)
        self.vocab = {t: k for k, t in enumerate(sorted(df))}
        self.idf = np.array([math.log((1 + n) / (1 + df[t])) + 1 for t in sorted(df)], np.float32)
        self.unseen = np.float32(math.log(1 + n) + 1)
        self.starred = {}
        for t in sorted(self.vocab, key=lambda t: df[t]):
            for k in range(len(t)) if len(t) > 3 else ():
                self.starred[t[:k] + "*" + t[k + 1 :]] = t
        order = sorted(range(n), key=lambda k: (not cases[k] > 0, docs[k]))
        self.docs = [docs[k] for k in order]
        self.cases = np.asarray(cases, np.float32)[order]
        self.records = np.array([records[k] for k in order], np.int32)
        self.at, self.ids, self.weights = self.vectors(self.docs)
        self.ids = self.ids.astype(np.int32)
        held = int((self.cases > 0).sum())  # the first docs
        self.all = Postings(self.at, self.ids, self.weights, n, BLOCK, len(self.vocab))
        self.held = Postings(self.at, self.ids, self.weights, held, CASE_BLOCK, len(self.vocab))

    def cosines(self, dense: np.ndarray, blocks: np.ndarray, postings: Postings) -> tuple[np.ndarray, np.ndarray]:
        """(docs, cosines) of all docs in the blocks with a query laid out over the vocabulary."""
        docs, cos = [], []
        for a in (blocks * postings.size).tolist():
            b = min(a + postings.size, postings.n)
            at = self.at[a : b + 1]
            part = slice(at[0], at[-1])
            docs.append(np.arange(a, b))
            cos.append(np.add.reduceat(dense[self.ids[part]] * self.weights[part], at[:-1] - at[0]))
        return (np.concatenate(docs), np.concatenate(cos)) if docs else (np.zeros(0, np.int64), np.zeros(0, np.float32))

    def tokens(self, stretch: str) -> tuple[str, ...]:
        return tuple(_WORD.findall(undisguise(stretch, self.starred)))

    def vector(self, tokens) -> tuple[np.ndarray, np.ndarray]:
        """(term ids, unit weights) of the known terms; unknown ones count in the length."""
        tf = Counter(tokens)
        known = [(self.vocab[t], n) for t, n in tf.items() if t in self.vocab]
        ids = np.array([k for k, _ in known], np.int32)
        w = np.array([1 + math.log(n) for _, n in known], np.float32) * self.idf[ids]
        rest = sum((1 + math.log(n)) ** 2 for t, n in tf.items() if t not in self.vocab)
        norm = math.sqrt(float(w @ w) + rest * float(self.unseen) ** 2)
        return ids, w / np.float32(norm or 1)

    def vectors(self, lists: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start of each list, term ids, unit weights) of many token lists at once.

        Unknown terms keep their weight under the id past the vocabulary, where no doc has any.
        Equal unknown terms of one list count as different ones.
        """
        v = len(self.vocab)
        get = self.vocab.get
        flat = np.array([get(t, v) for tokens in lists for t in tokens], np.int64)
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        key, count = np.unique(owner * (v + 1) + flat, return_counts=True)
        ids = key % (v + 1)
        owner = key // (v + 1)
        idf = np.append(self.idf, self.unseen)[ids]
        w = np.where(ids < v, 1 + np.log(count), np.sqrt(count)) * idf
        norm = np.sqrt(np.bincount(owner, w * w, len(lists)))
        w = (w / np.maximum(norm, 1e-9)[owner]).astype(np.float32)
        return np.searchsorted(owner, np.arange(len(lists) + 1)), ids, w

    def may_be_case(self, at: np.ndarray, ids: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Whether any case lies within CASE_RADIUS; others can have no vote for a case."""
        return self.best_case(at, ids, w) > 0

    def best_case(self, at: np.ndarray, ids: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Cosine of the nearest case, 0 beyond CASE_RADIUS.

        Lists that pass the bound over the blocks of cases are compared with the cases of the
        blocks that pass.
        """
        out = np.zeros(len(at) - 1, np.float32)
        least = CASE_RADIUS - 1e-5  # sums in another order differ by rounding
        dense = np.zeros(len(self.vocab) + 1, np.float32)
        some = max(1, min(2000, 4_000_000 // max(1, self.held.blocks)))
        for a in range(0, len(out) if self.held.n else 0, some):
            b = min(a + some, len(out))
            part = slice(at[a], at[b])
            rows, blocks = self.held.candidates(at[a : b + 1] - at[a], ids[part], w[part], least)
            ends = np.flatnonzero(np.diff(rows, append=-1)) + 1 if len(rows) else rows
            start = 0
            for end in ends.tolist():
                k = a + int(rows[start])
                one = slice(at[k], at[k + 1])
                dense[ids[one]] = w[one]
                dense[-1] = 0  # unknown terms are in no doc
                cos = self.cosines(dense, blocks[start:end], self.held)[1].max()
                out[k] = cos if cos >= least else 0
                dense[ids[one]] = 0
                start = end
        return out

    def nearest(self, ids: np.ndarray, w: np.ndarray, skip: int = -1, best_case: float = 1.0) -> list[tuple[float, int]]:
        """Exact (cosine, doc) of the nearest docs within the radius, best first.

        ``skip`` leaves out a doc that only one record holds: that record itself. Nothing comes
        back once all neighbours are nearer than ``best_case``: no case is among them.
        """
        dense = np.zeros(len(self.vocab) + 1, np.float32)
        dense[ids] = w
        dense[-1] = 0
        if best_case < 1:  # most queries have enough nearer docs where their weightiest terms meet
            rows, c = self.cosines(dense, self.all.likely(ids, w), self.all)
            if ((c > best_case + 2e-5) & (rows != skip)).sum() >= NEIGHBOURS:
                return []
        bound = self.all.bounds(ids, w)
        cos, doc, floor = np.zeros(0, np.float32), np.zeros(0, np.int64), RADIUS
        order = np.flatnonzero(bound >= RADIUS - 1e-5)
        order = order[np.argsort(-bound[order], kind="stable")]
        at, step = 0, 1
        while at < len(order) and bound[order[at]] >= floor - 1e-5:
            rows, c = self.cosines(dense, order[at : at + step], self.all)
            at, step = at + step, min(8, 2 * step)
            near = c >= floor
            near &= rows != skip
            cos, doc = np.concatenate([cos, c[near]]), np.concatenate([doc, rows[near]])
            if len(cos) > NEIGHBOURS:
                # ties at the edge stay in, so the result doesn't depend on the order of blocks
                floor = np.partition(cos, -NEIGHBOURS)[-NEIGHBOURS] - np.float32(1e-6)
                cos, doc = cos[cos >= floor], doc[cos >= floor]
                if floor > best_case + 1e-5:
                    return []
        best = np.lexsort((doc, -cos))
        return list(zip(cos[best].tolist(), doc[best].tolist()))

    def vote(self, found: list[tuple[float, int]]) -> float:
        """Share of the votes that speak for a case."""
        weight = [c * c * int(self.records[k]) for c, k in found]
        cases = sum(x * float(self.cases[k]) for x, (_, k) in zip(weight, found))
        return cases / (sum(weight) + DAMPING)


def fit(texts: list[str], ratings: list[float]) -> tuple[Index, list[tuple[float, float]]]:
    """(index, calibration) from labelled texts; nulls and empty texts are left out."""
    bare = Index([], np.zeros(0), [])
    records: list[list[tuple[str, ...]]] = []
    case: list[bool] = []
    for t, r in zip(texts, ratings):
        if not t or r is None:
            continue
        docs = [w for s in stretches(_plain(t)) for w in map(tuple, windows(list(bare.tokens(s)))) if w]
        if docs:
            records.append(list(dict.fromkeys(docs)))
            case.append(r >= CASE_RATING)
    holders: dict[tuple, list[int]] = defaultdict(list)
    for k, docs in enumerate(records):
        for d in docs:
            holders[d].append(k)
    docs = sorted(holders)
    docs_at = {d: k for k, d in enumerate(docs)}
    share = np.array([np.mean([case[k] for k in holders[d]]) for d in docs]) if docs else np.zeros(0)
    first = Index(docs, share, [len(holders[d]) for d in docs])
    place = {d: k for k, d in enumerate(first.docs)}
    # A case is harmful as a whole. To blame is its stretch that resembles those of other cases
    # most, and others that clearly do; where none does, those that resemble nothing at all share
    # the blame. Two rounds, the second with the blame of the first.
    base = sum(case) / max(1, len(case))
    near = {
        d: first.nearest(*first.vector(d), skip=at if first.records[at] == 1 else -1)
        for d, at in place.items()
        if share[docs_at[d]] > 0
    }
    for _ in range(2):
        blame: dict[tuple, float] = defaultdict(float)
        for k, docs_k in enumerate(records):
            if not case[k]:
                continue
            votes, alone = {}, []
            for d in docs_k:
                total = cases = 0.0
                for c, j in near[d]:
                    n, y = int(first.records[j]), float(first.cases[j]) * int(first.records[j])
                    if j == place[d]:  # the record itself has no vote
                        n, y = n - 1, max(0.0, y - 1)
                    total, cases = total + c * c * n, cases + c * c * y
                if total:
                    votes[d] = (cases + base) / (total + 1)
                else:
                    alone.append(d)
            top = max(votes.values(), default=0.0)
            if top >= (SURE_FROM if alone else BLAME_FROM):
                for d, v in votes.items():
                    if v >= top - 1e-9 or v >= SURE_FROM:
                        blame[d] += 1
            else:
                for d in alone:
                    blame[d] += 1 / len(alone)
        clean = np.array([blame[d] / len(holders[d]) for d in docs])
        first.cases = clean[[docs_at[d] for d in first.docs]].astype(np.float32) if docs else clean
    index = Index(docs, clean, [len(holders[d]) for d in docs])
    place = {d: k for k, d in enumerate(index.docs)}
    scores = [0.0] * len(records)
    parts = [(k, d) for k, docs_k in enumerate(records) for d in docs_k]
    at, ids, w = index.vectors([d for _, d in parts])
    best_case = index.best_case(at, ids, w)
    for j in np.flatnonzero(best_case):
        k, own = parts[j][0], place[parts[j][1]]
        one = slice(at[j], at[j + 1])
        found = index.nearest(ids[one], w[one], skip=own if index.records[own] == 1 else -1, best_case=best_case[j])
        scores[k] = max(scores[k], index.vote(found))
    raw = [(s, float(y)) for s, y in zip(scores, case)]
    return index, monotone(raw, len(records), sum(case))


def monotone(raw: list[tuple[float, float]], total: int, cases: int) -> list[tuple[float, float]]:
    """Steps (score from, probability), never falling: pooled adjacent violators.

    Cases and harmless records are each weighted up to their number among all labelled ones.
    """
    kept = sum(y for _, y in raw)
    up, up_case = (total - cases) / max(1.0, len(raw) - kept), cases / max(1.0, kept)
    ties: dict[float, list[float]] = {}  # score -> weight, weight of cases
    for s, y in raw:
        w = up_case if y else up
        tie = ties.setdefault(s, [0.0, 0.0])
        tie[0] += w
        tie[1] += w * y
    pools: list[list[float]] = []  # score from, weight, weight of cases
    # equal scores are one step, so none of them can join the step before without the others
    for s, (w, y) in sorted(ties.items()):
        pools.append([s, w, y])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            _, w2, y2 = pools.pop()
            pools[-1][1] += w2
            pools[-1][2] += y2
    return [(s, y / w) for s, w, y in pools]


def calibrated(score: float, steps: list[tuple[float, float]]) -> float:
    """Probability by linear interpolation between the steps; the score itself without any."""
    if not steps:
        return score
    xs, ys = [0.0, *(s for s, _ in steps), 1.0], [0.0, *(p for _, p in steps), 1.0]
    return float(np.interp(score, xs, ys))


def _scorer(shared, detail: bool):
    memo: dict[str, tuple] = {}

    def score_all(index: Index, parts: list[str]) -> None:
        """Fill the memo for distinct stretches that aren't in it."""
        if len(memo) > 300_000:
            memo.clear()
        lists, owner = [], []
        for k, s in enumerate(parts):
            memo[s] = (0.0, None, 0.0)
            tokens = _WORD.findall(undisguise(s, index.starred))
            for part in windows(tokens):
                lists.append(part)
                owner.append(k)
        at, ids, w = index.vectors(lists)
        best_case = index.best_case(at, ids, w)
        for j in np.flatnonzero(best_case):
            one = slice(at[j], at[j + 1])
            found = index.nearest(ids[one], w[one], best_case=best_case[j])
            if found:
                vote = index.vote(found)
                if vote > memo[parts[owner[j]]][0]:
                    best = max(found, key=lambda x: (index.cases[x[1]] >= 0.5, x[0]))
                    memo[parts[owner[j]]] = (vote, " ".join(index.docs[best[1]]), best[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, steps = pickle.loads(zlib.decompress(shared.value))
        for batch in batches:
            cut = [stretches(_plain(t)) if t else [] for t in batch.column(1).to_pylist()]
            new = list({s for c in cut for s in c if s not in memo})
            local = dict(memo) if len(memo) + len(new) > 300_000 else memo
            score_all(index, new)
            known = memo if local is memo else local | memo
            best = [max((known[s] for s in c), key=lambda x: x[0], default=(0.0, None, 0.0)) for c in cut]
            keys = batch.column(0)
            if not detail:
                hit = [k for k, b in enumerate(best) if b[0] > 0]
                keys, best = keys.take(pa.array(hit, pa.int64())), [best[k] for k in hit]
            out = [
                keys,
                pa.array([calibrated(b[0], steps) for b in best], pa.float64()),
                pa.array([b[1] for b in best], pa.string()),
                pa.array([b[2] for b in best], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(out, ["k", "score", "evidence", "similarity"])

    return run


def fitted(labels: DataFrame, texts: DataFrame) -> bytes:
    """The pickled index and calibration of at most MAX_LABELLED labelled records, fitted in one task.

    labels: k, rater, rating (repeated rows count once; a record has the mean rating); texts: k, text.
    """
    mean = labels.select("k", "rater", "rating").distinct().groupBy("k").agg(F.avg("rating").alias("rating"))
    mean = mean.orderBy(F.xxhash64("k"), "k").limit(MAX_LABELLED)
    rows = texts.join(F.broadcast(mean), "k").select("k", "text", "rating").dropDuplicates(["k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches]
        text = [t for b in held for t in b.column(1).to_pylist()]
        rating = [r for b in held for r in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(pickle.dumps(fit(text, rating)))], pa.binary())], ["model"])

    one = rows.repartition(1).sortWithinPartitions("k").mapInArrow(run, "model binary").collect()
    return bytes(one[0]["model"]) if one else zlib.compress(pickle.dumps(fit([], [])))


def score(texts: DataFrame, labels: DataFrame, detail: bool = True) -> DataFrame:
    """(k, score, evidence, similarity): probability that a text is abusive, hateful or sexual.

    texts: k, text; labels: k, rater, rating. ``evidence`` is the nearest labelled stretch that
    speaks for it. Null, empty and unlike texts get the lowest score without evidence; with
    ``detail`` false they are left out. Without labels every score is 0. Every stretch of every
    text is compared with the whole index; repeated rows come out repeated.
    """
    shared = texts.sparkSession.sparkContext.broadcast(fitted(labels, texts))
    return texts.select("k", "text").mapInArrow(
        _scorer(shared, detail), "k string, score double, evidence string, similarity double"
    )
