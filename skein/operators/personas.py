"""Records of authors for a simulated side: statistics, cards, packs, prompts, budgets, orders of speech."""

from __future__ import annotations

import json
import random
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.discussion import STRIP, clipped
from skein.operators.picks import author_samples, cast_of, spread_by_length

#: A comment of a simulated thread, and what a run of the simulation is set to and gives.
SIM_COMMENT = "agent string, body string, parent_id string, created_order long"
SIM_RESULT = (
    "post_id string, protocol string, structure string, speaking_order string, model string, "
    "comments array<struct<agent:string,body:string,parent_id:string,created_order:bigint>>"
)


@dataclass(frozen=True)
class Simulation:
    """Settings of a simulated thread."""

    model: str = "stub"
    temperature: float = 0.9
    max_tokens: int = 200
    n_agents: int = 3
    order: str = "round_robin"
    structure: str = "flat"
    reply_share: float = 0.25
    protocol: str = "post_only"
    prefix: int = 10
    most: int = 100
    seed: int = 42
    names: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.order not in ("round_robin", "random") or self.structure not in ("flat", "weak_tree") or self.protocol not in ("post_only", "prefix10"):
            raise ValueError("unknown order, structure or protocol")
        if self.n_agents < 1 or not 0 <= self.reply_share <= 1:
            raise ValueError("no agents or a share outside 0 to 1")


def check_arms(arms: list[dict], tiers: tuple[str, ...] = ("low", "mid", "high"), each: int = 2) -> None:
    """Raise ValueError unless the arms have different names, a model each and ``each`` of them are in every tier."""
    names = [a.get("name") for a in arms]
    if len(set(names)) != len(arms) or not all(names):
        raise ValueError("arms need different names")
    if any(not a.get("model") for a in arms):
        raise ValueError("every arm needs a model")
    for t in tiers:
        if sum(a.get("tier") == t for a in arms) != each:
            raise ValueError(f"tier {t} needs {each} arms")
    if len(arms) != each * len(tiers):
        raise ValueError("an arm outside the tiers")


def cross_counts(turns: DataFrame) -> DataFrame:
    """author, n_threads: in how many threads each author takes part."""
    return turns.groupBy("author").agg(F.countDistinct("post_id").alias("n_threads"))


def compact_history(records: DataFrame, blocked: DataFrame) -> DataFrame:
    """author, subreddit, post_id, body: history records outside blocked posts; null posts and communities become empty.

    records: those columns, as read by :func:`skein.sources.readers.history`; blocked: post_id.
    """
    out = records.join(blocked.select("post_id").distinct(), "post_id", "left_anti")
    none = F.lit("")
    return out.select("author", F.coalesce("subreddit", none).alias("subreddit"), F.coalesce("post_id", none).alias("post_id"), "body")


def history_stats(turns: DataFrame, thin_below: int = 5, top: int = 5) -> DataFrame:
    """author, n_comments, n_subreddits, top_subreddits, len_p10, len_median, len_p90, thin.

    turns: author, subreddit (null counts as the nameless one), body, created_utc, id. Communities come
    by number of comments, of equals the one seen first; quantiles of lengths are cut to whole numbers.
    """
    lengths = turns.groupBy("author", F.length("body").alias("x")).agg(F.count("*").alias("k"))
    q = lambda p: F.floor(F.round(F.percentile("x", F.lit(p), F.col("k")), 6))
    spread = lengths.groupBy("author").agg(F.sum("k").alias("n_comments"), q(0.1).alias("len_p10"), q(0.5).alias("len_median"), q(0.9).alias("len_p90"))
    per = turns.groupBy("author", F.coalesce("subreddit", F.lit("")).alias("name")).agg(F.count("*").alias("n"), F.min(F.struct("created_utc", "id")).alias("f"))
    counts = per.groupBy("author").agg(F.count("*").alias("n_subreddits"))
    w = Window.partitionBy("author").orderBy(F.desc("n"), F.col("f"))
    best = per.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top)
    tops = best.groupBy("author").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "name", "n"))), lambda s: F.struct(s["name"].alias("name"), s["n"].alias("n"))).alias("top_subreddits"))
    out = spread.join(counts, "author").join(tops, "author")
    return out.select("author", "n_comments", "n_subreddits", "top_subreddits", "len_p10", "len_median", "len_p90", (F.col("n_comments") < thin_below).alias("thin"))


def author_packs(turns: DataFrame, n: int = 6, most: int = 160) -> DataFrame:
    """author, lengths, samples: how often an author wrote comments of each length, and clipped samples.

    turns: author, post_id, id, pos, body, thread_created. lengths: (n_chars, n) by n_chars, so that
    an author of any number of comments takes the place of their distinct lengths.
    """
    counts = turns.groupBy("author", F.length("body").cast("long").alias("n_chars")).agg(F.count("*").alias("n"))
    lengths = counts.groupBy("author").agg(F.array_sort(F.collect_list(F.struct("n_chars", "n"))).alias("lengths"))
    first = author_samples(turns, n).join(turns.select("post_id", "id", "body"), ["post_id", "id"])
    one = F.struct("rank", "post_id", clipped(F.col("body"), most).alias("body"))
    samples = first.groupBy("author").agg(F.transform(F.array_sort(F.collect_list(one)), lambda s: F.struct(s["post_id"].alias("post_id"), s["body"].alias("body"))).alias("samples"))
    return lengths.join(samples, "author")


def manifest(threads: DataFrame, turns: DataFrame, indexed: DataFrame, least: int, most: int, cast: int, in_thread: int, elsewhere: int = 2) -> DataFrame:
    """post_id, n_comments, in_band, cast_ok, index_ok: which threads may be replayed.

    In the band of lengths; with a cast of frequent authors; with all of the cast in the index (author).
    """
    n = turns.groupBy("post_id").agg(F.count("*").alias("n_comments"))
    chosen = cast_of(turns, cast, in_thread, cross_counts(turns), elsewhere)
    known = indexed.select("author").distinct().withColumn("__k", F.lit(True))
    full = chosen.join(known, "author", "left").groupBy("post_id").agg(F.bool_and(F.coalesce("__k", F.lit(False))).alias("__all"))
    out = threads.select("post_id").join(n, "post_id", "left").join(full, "post_id", "left")
    band = F.coalesce(F.col("n_comments").between(least, most), F.lit(False))
    return out.select(
        "post_id", F.coalesce("n_comments", F.lit(0)).alias("n_comments"), band.alias("in_band"), (band & F.col("__all").isNotNull()).alias("cast_ok"),
        (band & F.coalesce("__all", F.lit(False))).alias("index_ok"),
    )


def manifest_totals(rows: DataFrame) -> DataFrame:
    """One row: threads, and how many pass each step of :func:`manifest`."""
    return rows.agg(F.count("*").alias("n_threads"), *[F.count_if(c).alias(c) for c in ("in_band", "cast_ok", "index_ok")])


def token_budget(p90: Column, chars_per_token: float, least: int, most: int) -> Column:
    """Tokens a reply may take: the long end of an author's comments and 60 more, within bounds."""
    return F.least(F.greatest(F.floor(p90 / max(chars_per_token, 1e-6)) + 60, F.lit(least)), F.lit(most)).cast("long")


def card_fields(text: str | None) -> dict[str, str] | None:
    """stance, tone and quirks of the first JSON object in a text; None if there is none or all are empty."""
    text = (text or "").strip()
    start = text.find("{")
    if start < 0:
        return None
    try:
        found, _ = json.JSONDecoder().raw_decode(text, start)
    except json.JSONDecodeError:
        try:
            found = json.loads(text[start : text.rfind("}") + 1])
        except json.JSONDecodeError:
            return None
    if not isinstance(found, dict):
        return None
    out = {k: str(found.get(k, "")).strip() for k in ("stance", "tone", "quirks")}
    return out if any(out.values()) else None


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("stance", "tone", "quirks")]))
def parse_card(text: pd.Series) -> pd.DataFrame:
    """The fields of raw cards; empty where there are none."""
    none = dict.fromkeys(("stance", "tone", "quirks"), "")
    return pd.DataFrame([card_fields(t) or none for t in text], columns=list(none))


def card_prompts(turns: DataFrame, n: int, most: int) -> DataFrame:
    """author, prompt: what a card would be written from: statistics and comments spread by length.

    Comments come in order of length until ``most`` characters are used; the last one is cut there.
    """
    stats = history_stats(turns)
    some = spread_by_length(turns, "author", n).withColumn("b", F.regexp_replace("body", STRIP, ""))
    per = some.groupBy("author").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "b"))), lambda s: s["b"]).alias("bodies"))

    def add(a: Column, b: Column) -> Column:
        left = F.lit(most) - a["used"]
        piece = F.when(F.length(b) <= left, b).otherwise(b.substr(F.lit(1), F.greatest(left, F.lit(0))))
        done = F.length(piece) == 0
        line = F.concat(F.lit("["), (a["k"] + 1).cast("string"), F.lit("] "), piece)
        return F.struct(
            F.when(done, a["lines"]).otherwise(F.concat(a["lines"], F.array(line))).alias("lines"), (a["k"] + 1).alias("k"), (a["used"] + F.length(piece)).alias("used")
        )

    zero = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(0).alias("k"), F.lit(0).alias("used"))
    lines = F.aggregate("bodies", zero, add, lambda a: a["lines"])
    tops = F.array_join(F.transform("top_subreddits", lambda x: F.concat(F.lit("r/"), x["name"], F.lit(" x"), x["n"].cast("string"))), ", ")
    head = F.concat(
        F.lit("Comments: "), F.col("n_comments"), F.lit(" in "), F.col("n_subreddits"), F.lit(" communities ("), tops, F.lit("). Length "), F.col("len_p10"), F.lit(" to "), F.col("len_p90"),
        F.lit(", median "), F.col("len_median"), F.lit("."),
    )
    ask = F.lit("Answer with JSON: stance, tone and quirks of this author, as the comments show them.")
    return stats.join(per, "author").select("author", F.array_join(F.concat(F.array(head, F.lit("")), lines, F.array(F.lit(""), ask)), "\n").alias("prompt"))


def turn_prompt(title: Column, selftext: Column, shown: Column, target: Column) -> Column:
    """What an agent is asked for its turn: the post, the turns it may see and the length wanted.

    shown: array of (place, alias, body) structs, places from 0; target: characters, null for no wish.
    """
    body = F.regexp_replace(F.coalesce(selftext, F.lit("")), STRIP, "")
    lines = F.transform(shown, lambda s: F.concat(F.lit("["), (s["place"] + 1).cast("string"), F.lit("] "), s["alias"], F.lit(": "), s["body"]))
    so_far = F.when(F.size(shown) > 0, F.concat(F.lit("\n\nSo far:\n"), F.array_join(lines, "\n"))).otherwise(F.lit("\n\nNobody has commented yet."))
    wish = F.coalesce(F.concat(F.lit(" About "), target.cast("string"), F.lit(" characters.")), F.lit(""))
    post = F.concat(F.lit("Title: "), F.regexp_replace(F.coalesce(title, F.lit("")), STRIP, ""), F.when(body == "", "").otherwise(F.concat(F.lit("\n\n"), body)))
    return F.concat(post, so_far, F.lit("\n\nWrite your comment."), wish)


def round_robin(pos: Column, n_agents: int) -> Column:
    return F.concat(F.lit("Agent-"), (pos % n_agents + 1).cast("string"))


def speakers(n_agents: int, n: int, order: str, seed: int) -> list[str]:
    """Who speaks at each turn: in turn, or each round in an order of its own."""
    names, rnd, out = [f"Agent-{k + 1}" for k in range(n_agents)], random.Random(seed), []
    while len(out) < n:
        out += names if order == "round_robin" else rnd.sample(names, n_agents)
    return out[:n]


def parent_of(history: list[tuple[str, int]], structure: str, reply_share: float, rnd: random.Random) -> str | None:
    """The turn that a new one replies to: none in a flat thread, else at times one of the last three."""
    if structure == "flat" or not history or rnd.random() > reply_share:
        return None
    agent, k = rnd.choice(history[-3:])
    return f"{agent}#{k}"


def simulate(posts: DataFrame, cfg: Simulation, generate, n: Column) -> DataFrame:
    """post_id, agent, body, parent_id, created_order: a simulated thread for each post, turn after turn.

    ``generate(prompt, agent, k) -> text`` is called in the tasks and must be picklable; no model comes
    with this library. The draws of a thread hang on its post and the seed only. posts: post_id, title, selftext.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r, rows, history = pdf.iloc[0], [], []
        seed = f"{cfg.seed}:{key[0]}"
        rnd = random.Random(seed)
        count = min(int(r["__n"]), cfg.most)
        for k, agent in enumerate(speakers(cfg.n_agents, count, cfg.order, seed)):
            parent = parent_of(history, cfg.structure, cfg.reply_share, rnd)
            prompt = f"Title: {r['title'] or ''}\n\n{r['selftext'] or ''}\n\n" + "\n".join(f"[{a}] {b}" for a, b, *_ in rows[-10:])
            rows.append((agent, generate(prompt, agent, k), parent, k))
            history.append((agent, k))
        return pd.DataFrame([(key[0], *x) for x in rows], columns=["post_id", "agent", "body", "parent_id", "created_order"])

    slim = posts.select("post_id", "title", "selftext", n.alias("__n")).dropDuplicates(["post_id"])
    return slim.groupBy("post_id").applyInPandas(run, f"post_id string, {SIM_COMMENT}")
