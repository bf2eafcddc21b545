"""Queries over threads, comments, authors and simulated turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import contracts, discussion, personas, picks
from skein.operators.discussion import linearise
from skein.operators.hierarchy import fullname_id
from skein.operators.orderparams import radial_curve
from skein.operators.orderparams import text_windows as windows
from skein.session import cut
from skein.sources.tables import table
from skein.sources.views import comments, threads, turns


def _r(*names: str) -> list:
    return [F.round(F.col(n), 6).alias(n) for n in names]


def clean_comments(spark: SparkSession, d: str) -> DataFrame:
    return comments(spark, d).select("post_id", "id", "author", F.md5("body").alias("body_md5"), "created_utc")


def linearize(spark: SparkSession, d: str) -> DataFrame:
    return linearise(comments(spark, d)).select("post_id", "id", "pos")


def thread_turns(spark: SparkSession, d: str) -> DataFrame:
    """Positions over the comments of persons only."""
    return turns(spark, d).select("post_id", "id", "pos")


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return windows(linearise(comments(spark, d)).withColumnRenamed("post_id", "thread_id"))


def text_windows(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d).select("thread_id", "win", F.md5("text").alias("text_md5"))


def lexical_growth(spark: SparkSession, d: str) -> DataFrame:
    return discussion.lexical_growth(_windows(spark, d))


def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    titles = threads(spark, d).select(F.col("post_id").alias("id"), F.col("title").alias("text"))
    return discussion.hash_embed(titles).select("id", "bucket", *_r("weight"))


def hash_embed_300(spark: SparkSession, d: str) -> DataFrame:
    """Hashed vectors of a size that is no power of two."""
    titles = threads(spark, d).select(F.col("post_id").alias("id"), F.col("title").alias("text"))
    return discussion.hash_embed(titles, 300).select("id", "bucket", *_r("weight"))


def hash_radial(spark: SparkSession, d: str) -> DataFrame:
    """Curve of each thread from hashed vectors of its comments."""
    t = cut(turns(spark, d).select("post_id", "id", "pos", F.col("body").alias("text")), "turns")
    v = discussion.hash_vectors(t, 64).select(F.col("post_id").alias("thread_id"), "pos", "e")
    return radial_curve(v).select("thread_id", "win", *_r("sim_first", "sim_prev"), "n")


def post_text(spark: SparkSession, d: str) -> DataFrame:
    return threads(spark, d).select("post_id", F.md5(discussion.post_text(F.col("title"), F.col("selftext"))).alias("text_md5"))


def clipped_comments(spark: SparkSession, d: str) -> DataFrame:
    return comments(spark, d).select("id", discussion.clipped(F.col("body"), 60).alias("clip"))


def unusable_titles(spark: SparkSession, d: str) -> DataFrame:
    return threads(spark, d).filter(discussion.unusable(F.col("title"))).select("post_id")


def orphan_comments(spark: SparkSession, d: str) -> DataFrame:
    """Comments whose parent is no comment of their post, whatever form the parent is written in."""
    c = table(spark, d, "comments").select("post_id", "id", "parent_id").dropDuplicates(["post_id", "id"])
    bare = fullname_id(F.col("parent_id"))
    up = c.filter(F.col("parent_id").isNotNull() & ~F.col("parent_id").startswith("t3_") & (bare != F.col("post_id"))).select("post_id", "id", bare.alias("up"))
    return up.join(c.select("post_id", F.col("id").alias("up")), ["post_id", "up"], "left_anti").select("post_id", "id")


def cross_thread_counts(spark: SparkSession, d: str) -> DataFrame:
    return personas.cross_counts(turns(spark, d)).filter("n_threads >= 2")


def cast_selection(spark: SparkSession, d: str) -> DataFrame:
    t = cut(turns(spark, d), "turns")
    return picks.cast_of(t, 3, 2, personas.cross_counts(t), 2).select("post_id", "author", "n", "r", "alias")


def alias_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return picks.aliases(turns(spark, d)).select("post_id", "author", "alias")


def author_stats(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d).join(threads(spark, d).select("post_id", "subreddit"), "post_id", "left")
    s = personas.history_stats(t)
    tops = F.array_join(F.transform("top_subreddits", lambda x: F.concat_ws(":", x["name"], x["n"].cast("string"))), ",")
    return s.select("author", "n_comments", "n_subreddits", tops.alias("tops"), "len_p10", "len_median", "len_p90", "thin")


def author_samples(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d).join(threads(spark, d).select("post_id", F.col("created_utc").alias("thread_created")), "post_id", "left")
    return picks.author_samples(t)


def verbatim_samples(spark: SparkSession, d: str) -> DataFrame:
    return picks.verbatim(turns(spark, d), "author", 3, 100).select("author", "id", "rank", F.md5("sample").alias("sample_md5"))


def length_spread(spark: SparkSession, d: str) -> DataFrame:
    return picks.spread_by_length(turns(spark, d), "author").select("author", "id", F.length("body").alias("n_chars"))


def upper_median(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d).withColumn("n_chars", F.length("body"))
    return picks.upper_median(t, "author", "n_chars")


def token_budgets(spark: SparkSession, d: str) -> DataFrame:
    """Tokens each author's cards allow, from the long end of their comments."""
    c = table(spark, d, "persona_cards").filter("stats is not null")
    return c.select("author", personas.token_budget(F.col("stats.len_p90"), 3.5, 80, 400).alias("max_tokens"))


def author_packs(spark: SparkSession, d: str) -> DataFrame:
    """Number and total of lengths and the samples of each author's pack."""
    t = turns(spark, d).join(threads(spark, d).select("post_id", F.col("created_utc").alias("thread_created")), "post_id", "left")
    p = personas.author_packs(t)
    total = lambda f: F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + f(x))
    return p.select("author", total(lambda x: x["n"]).alias("n"), total(lambda x: x["n"] * x["n_chars"]).alias("chars"), F.size("samples").alias("n_samples"))


def eligibility_manifest(spark: SparkSession, d: str) -> DataFrame:
    """For each thread whether its length, its cast and the index of its authors admit it."""
    indexed = table(spark, d, "persona_cards").select("author")
    return personas.manifest(threads(spark, d), turns(spark, d), indexed, 10, 1000, 3, 2)


def history_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Comments of each author outside the threads that have a simulated side."""
    blocked = table(spark, d, "sim_comments").select("post_id")
    return picks.not_blocked(turns(spark, d), blocked).groupBy("author").agg(F.count("*").alias("n"))


def card_precedence(spark: SparkSession, d: str) -> DataFrame:
    """Where the card of each author of a simulated side comes from."""
    s = table(spark, d, "sim_comments")
    cards = table(spark, d, "persona_cards").select("author", F.lit("history").alias("source"), F.nullif("raw_card", F.lit("")).alias("card"), "error")
    return picks.preferred(s.filter("author is not null"), "author", cards.filter("length(author) % 2 = 0"), cards, "history").select("author", "origin")


def parsed_cards(spark: SparkSession, d: str) -> DataFrame:
    """The three fields of the first JSON object in each raw card."""
    c = table(spark, d, "persona_cards").select("author", personas.parse_card(F.col("raw_card")).alias("f"))
    return c.select("author", F.md5("f.stance").alias("stance"), F.md5("f.tone").alias("tone"), F.md5("f.quirks").alias("quirks"))


def card_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The prompt from which each author's card would be written."""
    t = turns(spark, d).join(threads(spark, d).select("post_id", "subreddit"), "post_id", "left")
    return personas.card_prompts(t, 6, 1200).select("author", F.md5("prompt").alias("prompt_md5"))


def speaking_order(spark: SparkSession, d: str) -> DataFrame:
    """The agent of each turn when three agents speak in turn."""
    return turns(spark, d).select("post_id", "pos", personas.round_robin(F.col("pos"), 3).alias("agent"))


def merge_first_wins(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "comments").select("id", F.unix_micros("retrieved_at").alias("retrieved_us"), "score")
    return picks.merged(c, "id", ["retrieved_us", "score"]).select("id", "retrieved_us", F.col("score").cast("string").alias("score"))


def merge_last_wins(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "comments").select("id", F.unix_micros("retrieved_at").alias("retrieved_us"), "score")
    m = picks.merged(c, "id", ["retrieved_us", "score"], last=True)
    return m.select("id", "retrieved_us", F.col("score").cast("string").alias("score"), F.col("seen.retrieved_us").alias("first_us"))


def first_seen_authors(spark: SparkSession, d: str) -> DataFrame:
    return picks.first_seen(turns(spark, d), "author", ["created_utc", "id"])


def preferred_first(spark: SparkSession, d: str) -> DataFrame:
    """Threads with a simulated side before the others."""
    return picks.preferred_first(threads(spark, d).select("post_id"), "post_id", table(spark, d, "sim_comments")).select("post_id", "place")


def eligible_slice(spark: SparkSession, d: str) -> DataFrame:
    """Threads 10 to 59 in order of creation among those of ten comments or more."""
    n = turns(spark, d).groupBy("post_id").agg(F.count("*").alias("n")).filter("n >= 10")
    t = threads(spark, d).join(n, "post_id").select("post_id", "created_utc")
    return picks.eligible_slice(t, [F.col("created_utc"), F.col("post_id")], 10, 50).select("post_id")


def wanted_threads(spark: SparkSession, d: str) -> DataFrame:
    """Threads asked for by the simulated side, and those of them that are missing."""
    ids = table(spark, d, "sim_comments").select("post_id")
    found, missing = picks.wanted(threads(spark, d).select("post_id"), ids, "post_id")
    return found.withColumn("found", F.lit(True)).unionByName(missing.withColumn("found", F.lit(False)))


def label_lookup(spark: SparkSession, d: str) -> DataFrame:
    """How many turns of each model have an author with a card of each kind."""
    s = table(spark, d, "sim_comments").dropDuplicates(["post_id", "position"])
    kinds = table(spark, d, "persona_cards").select("author", F.when(F.coalesce("error", F.lit("")) == "", "valid").otherwise("failed").alias("card"))
    return picks.labelled(s, kinds, "author", "card").groupBy(F.coalesce("response_model", F.lit("(none)")).alias("model"), "card").agg(F.count("*").alias("n"))


def middle_thread(spark: SparkSession, d: str) -> DataFrame:
    """The thread of each community whose length is nearest to 30 comments."""
    n = turns(spark, d).groupBy("post_id").agg(F.count("*").alias("n"))
    t = threads(spark, d).filter("subreddit is not null").join(n, "post_id").select("subreddit", "post_id", "n")
    return picks.nearest(t, "subreddit", F.abs(F.col("n") - 30), [F.col("post_id")])


def community_rollup(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d).join(threads(spark, d).select("post_id", "subreddit"), "post_id")
    return t.groupBy("subreddit").agg(F.count("*").alias("n_comments"), F.countDistinct("post_id").alias("n_threads"), F.round(F.avg(F.length("body")), 6).alias("mean_chars"))


def _replay(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Human turns, headers and simulated turns; the original of a turn is the comment it replaces."""
    s = table(spark, d, "sim_comments").dropDuplicates(["post_id", "position"])
    c = table(spark, d, "comments").select(F.col("post_id").alias("__p"), "id", "author", "body").dropDuplicates(["__p", "id"])
    pair = s.select("post_id", "position", "comment_id", "alias").join(c, (F.col("post_id") == F.col("__p")) & (F.col("comment_id") == F.col("id")))
    human = pair.select("post_id", "position", "author", "alias", "comment_id", "body")
    heads = human.groupBy("post_id").agg(F.count("*").alias("n_turns")).withColumn("file_id", F.col("post_id"))
    return human, heads, s.withColumnRenamed("post_id", "file_id")


def replay_violations(spark: SparkSession, d: str) -> DataFrame:
    return contracts.replay_violations(*_replay(spark, d))


def replay_audit(spark: SparkSession, d: str) -> DataFrame:
    return contracts.replay_audit(*_replay(spark, d))


def side_lengths(spark: SparkSession, d: str) -> DataFrame:
    human, _, sim = _replay(spark, d)
    pair = human.select("post_id", "position", F.length("body").alias("h")).join(sim.select(F.col("file_id").alias("post_id"), "position", F.length("body").alias("s")), ["post_id", "position"])
    return pair.groupBy("post_id").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("sim_chars"), F.round(F.avg("h"), 6).alias("human_chars"))


def failure_counts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sim_comments").dropDuplicates(["post_id", "position"])
    return s.groupBy(F.coalesce("response_model", F.lit("(none)")).alias("model")).agg(
        F.count("*").alias("n"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("n_errors"), F.count_if(F.coalesce("truncated", F.lit(False))).alias("n_flagged"),
    )


def history_views(spark: SparkSession, d: str) -> DataFrame:
    """What each simulated turn may see: the last three turns and a draw of two earlier ones."""
    s = table(spark, d, "sim_comments").select("post_id", "position").distinct()
    lit = lambda x: F.lit(x).cast("long")
    return s.select("post_id", "position", picks.history_view(F.col("position"), lit(3), lit(2), lit(42), F.col("post_id"), F.col("position")).alias("shown"))


def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """Five threads of each community in an order fixed by a seed."""
    return picks.shuffled(threads(spark, d).filter("subreddit is not null").select("subreddit", "post_id"), "subreddit", "post_id", 5)


def plot_subsample(spark: SparkSession, d: str) -> DataFrame:
    return picks.subsample(threads(spark, d).select("post_id"), "post_id", 100)


NAMES = (
    "clean_comments linearize thread_turns text_windows lexical_growth hash_embed hash_embed_300 hash_radial post_text clipped_comments unusable_titles orphan_comments "
    "cross_thread_counts cast_selection alias_first_seen author_stats author_samples verbatim_samples length_spread upper_median token_budgets author_packs "
    "eligibility_manifest history_antijoin card_precedence parsed_cards card_prompts speaking_order merge_first_wins merge_last_wins first_seen_authors "
    "preferred_first eligible_slice wanted_threads label_lookup middle_thread community_rollup replay_violations replay_audit side_lengths failure_counts "
    "history_views seeded_sample plot_subsample"
).split()
QUERIES = {n: globals()[n] for n in NAMES}

_STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}\x{{85}}]+|[\s\p{{Z}}\x{{85}}]+$', '', 'g')"
_CLEAN = rf"""
WITH RECURSIVE c AS (SELECT DISTINCT post_id, id, CASE WHEN contains(parent_id, '_') THEN substr(parent_id, strpos(parent_id, '_') + 1) ELSE parent_id END AS parent_id,
  coalesce(starts_with(parent_id, 't3_'), false) AS to_post,
  coalesce(nullif(author, ''), '[unknown]') AS author, {_STRIP.format("body")} AS body, coalesce(created_utc, 0.0) AS created_utc FROM comments
  WHERE {_STRIP.format("body")} NOT IN ('', '[deleted]', '[removed]')),
th AS (SELECT post_id, title, selftext, subreddit, created_utc FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY retrieved_at DESC) AS r FROM threads) WHERE r = 1)"""
_TREE = """,
tree AS (
  SELECT post_id, id, [{'t': created_utc, 'i': id}] AS way FROM c WHERE to_post OR parent_id IS NULL OR parent_id = post_id
  UNION ALL SELECT c.post_id, c.id, list_append(tree.way, {'t': c.created_utc, 'i': c.id}) FROM tree JOIN c ON c.post_id = tree.post_id AND c.parent_id = tree.id AND NOT c.to_post AND c.parent_id <> c.post_id),
lin AS (SELECT c.*, row_number() OVER (PARTITION BY c.post_id ORDER BY tree.way IS NULL, coalesce(tree.way, [{'t': c.created_utc, 'i': c.id}])) - 1 AS pos
  FROM c LEFT JOIN tree ON tree.post_id = c.post_id AND tree.id = c.id)"""
_LINEAR = _CLEAN + _TREE + """,
w AS (SELECT post_id AS thread_id, pos // 10 AS win, string_agg(body, chr(10) || chr(10) ORDER BY pos) AS text FROM lin GROUP BY 1, 2)"""
_TURNS = _CLEAN + _TREE + """,
tu AS (SELECT post_id, id, author, body, created_utc, row_number() OVER (PARTITION BY post_id ORDER BY pos) - 1 AS pos FROM lin WHERE author NOT IN ('', '[deleted]', '[removed]', 'AutoModerator', '[unknown]'))"""
_CROSS = ", x AS (SELECT author, count(DISTINCT post_id) AS n_threads FROM tu GROUP BY 1)"
_PER = """, per AS (SELECT post_id, author, count(*) AS n, min(pos) AS f FROM tu GROUP BY 1, 2)"""
_REPLAY = f"""
WITH s AS (SELECT DISTINCT ON (post_id, position) * FROM sim_comments), c AS (SELECT DISTINCT post_id, id, author, body FROM comments),
h AS (SELECT s.post_id, position, c.author, alias, comment_id, c.body FROM s JOIN c ON c.post_id = s.post_id AND c.id = s.comment_id),
n AS (SELECT post_id, count(*) AS n FROM h GROUP BY 1), m AS (SELECT post_id, count(*) AS m FROM s GROUP BY 1),
v AS (SELECT post_id, CAST(NULL AS BIGINT) AS position, 'turn counts differ' AS reason FROM n JOIN m USING (post_id) WHERE n <> m
  UNION ALL SELECT * FROM (SELECT s.post_id, s.position, CASE WHEN h.post_id IS NULL THEN 'position differs' WHEN h.author IS NULL OR h.author IS DISTINCT FROM s.author THEN 'author differs'
    WHEN h.comment_id IS NULL THEN 'comment_id differs' WHEN h.alias IS NULL THEN 'alias differs' WHEN s.position >= n THEN 'gap in positions'
    WHEN coalesce(s.error, '') <> '' OR coalesce({_STRIP.format("s.body")}, '') = '' THEN 'failed or empty simulation' WHEN coalesce({_STRIP.format("h.body")}, '') = '' THEN 'empty human comment'
    WHEN shown_indices IS NULL OR len(list_distinct(shown_indices)) <> len(shown_indices) OR len(list_filter(shown_indices, lambda i: i IS NULL OR i < 0 OR i >= s.position)) > 0 THEN 'invalid visible history' END AS reason
    FROM s JOIN n ON n.post_id = s.post_id LEFT JOIN h ON h.post_id = s.post_id AND h.position = s.position) WHERE reason IS NOT NULL)"""


def _hashed(dim: int) -> str:
    return _CLEAN + rf""",
w AS (SELECT post_id AS id, unnest(regexp_split_to_array(lower(title), '[\s\p{{Z}}\x{{85}}]+')) AS w FROM th),
n AS (SELECT id, CAST(list_sum([CAST(CAST('0x' || substr(sha256(w), 2 * k + 1, 2) AS INTEGER) AS HUGEINT) * CAST(1 AS HUGEINT) * (CAST(256 AS HUGEINT) ** k)::HUGEINT FOR k IN range(0, 8)]) % {dim} AS INTEGER) AS bucket, count(*) AS n
  FROM w WHERE w <> '' GROUP BY 1, 2)
SELECT id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 6) AS weight FROM n"""


ORACLES = {
    "clean_comments": _CLEAN + " SELECT post_id, id, author, md5(body) AS body_md5, created_utc FROM c",
    "linearize": _LINEAR + " SELECT post_id, id, pos FROM lin",
    "thread_turns": _TURNS + " SELECT post_id, id, pos FROM tu",
    "text_windows": _LINEAR + " SELECT thread_id, win, md5(text) AS text_md5 FROM w",
    "lexical_growth": _LINEAR + r""",
words AS (SELECT thread_id, win, unnest(regexp_split_to_array(lower(text), '[\s\p{Z}\x{85}]+')) AS w FROM w),
first AS (SELECT thread_id, w, min(win) AS win FROM words WHERE w <> '' GROUP BY 1, 2),
n AS (SELECT thread_id, count(*) AS n FROM w GROUP BY 1)
SELECT thread_id, count(*) AS total, CASE WHEN max(n) = 1 THEN count(*) ELSE count(*) - count(*) FILTER (win = 0) END AS growth FROM first JOIN n USING (thread_id) GROUP BY 1""",
    "hash_embed": _hashed(256),
    "hash_embed_300": _hashed(300),
    "hash_radial": _TURNS + r""",
w AS (SELECT post_id, pos // 10 AS win, id, unnest(regexp_split_to_array(lower(body), '[\s\p{Z}\x{85}]+')) AS w FROM tu),
b AS (SELECT post_id, win, id, CAST('0x' || substr(sha256(w), 1, 2) AS INTEGER) % 64 AS b, count(*) AS k FROM w WHERE w <> '' GROUP BY ALL),
u AS (SELECT post_id, win, b, k / sqrt(sum(k * k) OVER (PARTITION BY post_id, id)) AS x FROM b),
z AS (SELECT post_id, pos // 10 AS win, count(*) AS n FROM tu GROUP BY 1, 2),
m AS (SELECT post_id, win, b, sum(x) / max(n) AS x FROM u JOIN z USING (post_id, win) GROUP BY ALL),
cv AS (SELECT post_id, win, b, x / sqrt(sum(x * x) OVER (PARTITION BY post_id, win)) AS x FROM m),
f AS (SELECT a.post_id, a.win, sum(a.x * b.x) AS s FROM cv a JOIN cv b ON b.post_id = a.post_id AND b.b = a.b AND b.win = 0 GROUP BY 1, 2),
p AS (SELECT a.post_id, a.win, sum(a.x * b.x) AS s FROM cv a JOIN cv b ON b.post_id = a.post_id AND b.b = a.b AND b.win = a.win - 1 GROUP BY 1, 2)
SELECT z.post_id AS thread_id, z.win, round(greatest(-1, least(1, coalesce(f.s, 0))), 6) AS sim_first, round(CASE WHEN z.win = 0 THEN 1 ELSE greatest(-1, least(1, coalesce(p.s, 0))) END, 6) AS sim_prev, z.n
FROM z LEFT JOIN f USING (post_id, win) LEFT JOIN p USING (post_id, win)""",
    "post_text": _CLEAN + rf""" SELECT post_id, md5(coalesce({_STRIP.format("title")}, '') || CASE WHEN coalesce({_STRIP.format("selftext")}, '') = '' THEN '' ELSE chr(10) || chr(10) || {_STRIP.format("selftext")} END) AS text_md5 FROM th""",
    "clipped_comments": _CLEAN + r""", f AS (SELECT id, regexp_replace(body, '[\s\p{Z}\x{85}]+', ' ', 'g') AS b FROM c)
SELECT id, CASE WHEN length(b) <= 60 THEN b WHEN contains(substr(b, 1, 60), ' ') THEN trim(regexp_replace(substr(b, 1, 60), ' [^ ]*$', '')) ELSE substr(b, 1, 60) END AS clip FROM f""",
    "unusable_titles": _CLEAN + f""" SELECT post_id FROM th WHERE lower(coalesce({_STRIP.format("title")}, '')) IN ('', '[removed]', '[deleted]', '[removed by moderator]')""",
    "orphan_comments": """
WITH c AS (SELECT DISTINCT post_id, id, parent_id, CASE WHEN contains(parent_id, '_') THEN substr(parent_id, strpos(parent_id, '_') + 1) ELSE parent_id END AS up FROM comments)
SELECT post_id, id FROM c WHERE parent_id IS NOT NULL AND NOT starts_with(parent_id, 't3_') AND up <> post_id AND NOT EXISTS (SELECT 1 FROM c p WHERE p.post_id = c.post_id AND p.id = c.up)""",
    "cross_thread_counts": _TURNS + _CROSS + " SELECT author, n_threads FROM x WHERE n_threads >= 2",
    "cast_selection": _TURNS + _CROSS + _PER + """,
k AS (SELECT post_id, author, n, row_number() OVER (PARTITION BY post_id ORDER BY n DESC, f) AS r FROM per JOIN x USING (author) WHERE n >= 2 AND n_threads >= 2)
SELECT post_id, author, n, CAST(r AS INTEGER) AS r, concat('Agent-', r) AS alias FROM k WHERE r <= 3 AND post_id IN (SELECT post_id FROM k WHERE r = 3)""",
    "alias_first_seen": _TURNS + _PER + " SELECT post_id, author, concat('Agent-', row_number() OVER (PARTITION BY post_id ORDER BY f)) AS alias FROM per",
    "author_stats": _TURNS + """,
p AS (SELECT author, coalesce(subreddit, '') AS s, length(body) AS n, tu.created_utc, id FROM tu LEFT JOIN th USING (post_id)),
k AS (SELECT author, s, count(*) AS n, min({'t': created_utc, 'i': id}) AS f FROM p GROUP BY 1, 2),
o AS (SELECT author, count(*) AS n_subreddits, string_agg(concat(s, ':', n), ',' ORDER BY n DESC, f) FILTER (r <= 5) AS tops FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY n DESC, f) AS r FROM k) GROUP BY 1)
SELECT author, count(*) AS n_comments, max(n_subreddits) AS n_subreddits, max(tops) AS tops, CAST(floor(round(quantile_cont(n, 0.1), 6)) AS BIGINT) AS len_p10, CAST(floor(round(quantile_cont(n, 0.5), 6)) AS BIGINT) AS len_median,
  CAST(floor(round(quantile_cont(n, 0.9), 6)) AS BIGINT) AS len_p90, count(*) < 5 AS thin FROM p JOIN o USING (author) GROUP BY 1""",
    "author_samples": _TURNS + """,
o AS (SELECT author, post_id, arg_min(id, pos) AS id FROM tu GROUP BY 1, 2),
r AS (SELECT author, o.post_id, o.id, row_number() OVER (PARTITION BY author ORDER BY th.created_utc NULLS FIRST, o.post_id) AS rank FROM o LEFT JOIN th USING (post_id))
SELECT author, post_id, id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 6""",
    "verbatim_samples": _TURNS + """,
m AS (SELECT author, CAST(floor(quantile_cont(length(body), 0.5)) AS BIGINT) AS m FROM tu GROUP BY 1),
r AS (SELECT author, id, body, row_number() OVER (PARTITION BY author ORDER BY abs(length(body) - m), id) AS rank FROM tu JOIN m USING (author))
SELECT author, id, CAST(rank AS INTEGER) AS rank, md5(substr(body, 1, 100)) AS sample_md5 FROM r WHERE rank <= 3""",
    "length_spread": _TURNS + """,
r AS (SELECT author, id, length(body) AS n_chars, row_number() OVER (PARTITION BY author ORDER BY length(body), id) - 1 AS i, count(*) OVER (PARTITION BY author) AS n FROM tu),
k AS (SELECT DISTINCT author, CASE WHEN n <= 5 THEN j ELSE CAST(round_even(j * (n - 1) / 4, 0) AS BIGINT) END AS i FROM (SELECT DISTINCT author, n FROM r) CROSS JOIN range(0, 5) t(j))
SELECT author, id, CAST(n_chars AS INTEGER) AS n_chars FROM r JOIN k USING (author, i)""",
    "upper_median": _TURNS + " SELECT author, CAST(list_sort(list(length(body)))[count(*) // 2 + 1] AS INTEGER) AS median FROM tu GROUP BY 1",
    "token_budgets": "SELECT author, CAST(least(greatest(CAST(floor(stats.len_p90 / 3.5) AS BIGINT) + 60, 80), 400) AS BIGINT) AS max_tokens FROM persona_cards WHERE stats IS NOT NULL",
    "author_packs": _TURNS + """ SELECT author, count(*) AS n, CAST(sum(length(body)) AS BIGINT) AS chars, CAST(least(6, count(DISTINCT post_id)) AS INTEGER) AS n_samples FROM tu GROUP BY 1""",
    "eligibility_manifest": _TURNS + _CROSS + _PER + """,
k AS (SELECT post_id, author, row_number() OVER (PARTITION BY post_id ORDER BY n DESC, f) AS r FROM per JOIN x USING (author) WHERE n >= 2 AND n_threads >= 2),
ca AS (SELECT post_id, bool_and(author IN (SELECT author FROM persona_cards)) AS index_ok FROM k WHERE r <= 3 AND post_id IN (SELECT post_id FROM k WHERE r = 3) GROUP BY 1),
nn AS (SELECT post_id, count(*) AS n FROM tu GROUP BY 1)
SELECT post_id, coalesce(nn.n, 0) AS n_comments, coalesce(nn.n BETWEEN 10 AND 1000, false) AS in_band, coalesce(nn.n BETWEEN 10 AND 1000 AND index_ok IS NOT NULL, false) AS cast_ok,
  coalesce(nn.n BETWEEN 10 AND 1000 AND index_ok, false) AS index_ok FROM th LEFT JOIN nn USING (post_id) LEFT JOIN ca USING (post_id)""",
    "history_antijoin": _TURNS + " SELECT author, count(*) AS n FROM tu WHERE post_id NOT IN (SELECT post_id FROM sim_comments) GROUP BY 1",
    "card_precedence": """
WITH v AS (SELECT author FROM persona_cards WHERE coalesce(error, '') = '' AND coalesce(raw_card, '') <> '')
SELECT DISTINCT author, CASE WHEN author NOT IN (FROM v) THEN 'new' WHEN length(author) % 2 = 0 THEN 'existing' ELSE 'reused' END AS origin FROM sim_comments WHERE author IS NOT NULL""",
    "speaking_order": _TURNS + " SELECT post_id, pos, concat('Agent-', pos % 3 + 1) AS agent FROM tu",
    "merge_first_wins": "SELECT id, epoch_us(retrieved_at) AS retrieved_us, CAST(score AS VARCHAR) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY retrieved_at, score NULLS FIRST) AS r FROM comments) WHERE r = 1",
    "merge_last_wins": """SELECT id, epoch_us(retrieved_at) AS retrieved_us, CAST(score AS VARCHAR) AS score, epoch_us(f) AS first_us FROM (SELECT *, min(retrieved_at) OVER (PARTITION BY id) AS f,
  row_number() OVER (PARTITION BY id ORDER BY retrieved_at DESC, score DESC NULLS LAST) AS r FROM comments) WHERE r = 1""",
    "first_seen_authors": _TURNS + ", f AS (SELECT author, min({'t': created_utc, 'i': id}) AS o FROM tu GROUP BY 1) SELECT author, row_number() OVER (ORDER BY o) - 1 AS place FROM f",
    "preferred_first": _CLEAN + " SELECT post_id, row_number() OVER (ORDER BY post_id NOT IN (SELECT post_id FROM sim_comments), post_id) - 1 AS place FROM th",
    "eligible_slice": _TURNS + """,
n AS (SELECT post_id, row_number() OVER (ORDER BY th.created_utc NULLS FIRST, post_id) - 1 AS k FROM th WHERE post_id IN (SELECT post_id FROM tu GROUP BY 1 HAVING count(*) >= 10)) SELECT post_id FROM n WHERE k >= 10 AND k < 60""",
    "wanted_threads": _CLEAN + " SELECT post_id, true AS found FROM th WHERE post_id IN (SELECT post_id FROM sim_comments) UNION SELECT post_id, false FROM sim_comments WHERE post_id NOT IN (SELECT post_id FROM th)",
    "label_lookup": """
WITH s AS (SELECT DISTINCT post_id, position, author, response_model FROM sim_comments)
SELECT coalesce(response_model, '(none)') AS model, CASE WHEN p.author IS NULL THEN 'unmatched' WHEN coalesce(p.error, '') = '' THEN 'valid' ELSE 'failed' END AS card, count(*) AS n FROM s LEFT JOIN persona_cards p ON p.author = s.author GROUP BY 1, 2""",
    "middle_thread": _TURNS + """,
n AS (SELECT post_id, count(*) AS n FROM tu GROUP BY 1),
r AS (SELECT subreddit, post_id, n, row_number() OVER (PARTITION BY subreddit ORDER BY abs(n - 30), post_id) AS r FROM th JOIN n USING (post_id) WHERE subreddit IS NOT NULL) SELECT subreddit, post_id, n FROM r WHERE r = 1""",
    "community_rollup": _TURNS + " SELECT subreddit, count(*) AS n_comments, count(DISTINCT post_id) AS n_threads, round(avg(length(body)), 6) AS mean_chars FROM tu JOIN th USING (post_id) GROUP BY 1",
    "replay_violations": _REPLAY + " SELECT post_id, position, reason FROM v",
    "replay_audit": _REPLAY + """,
f AS (SELECT post_id, arg_min(reason, {'p': coalesce(position, -1), 'r': reason}) AS why FROM v GROUP BY 1),
t AS (SELECT post_id, count(*) FILTER (truncated) AS k FROM s GROUP BY 1)
SELECT post_id, n AS n_turns, coalesce(k, 0) AS n_truncated, coalesce(why, CASE WHEN n <= 10 THEN 'short' END) IS NULL AS valid, coalesce(why, CASE WHEN n <= 10 THEN 'fewer than two windows' END) AS reason
FROM n LEFT JOIN f USING (post_id) LEFT JOIN t USING (post_id)""",
    "side_lengths": _REPLAY + " SELECT h.post_id, count(*) AS n, round(avg(length(s.body)), 6) AS sim_chars, round(avg(length(h.body)), 6) AS human_chars FROM h JOIN s USING (post_id, position) GROUP BY 1",
    "failure_counts": """
SELECT coalesce(response_model, '(none)') AS model, count(*) AS n, count(*) FILTER (coalesce(error, '') <> '') AS n_errors, count(*) FILTER (coalesce(truncated, false)) AS n_flagged
FROM (SELECT DISTINCT post_id, position, response_model, error, truncated FROM sim_comments) GROUP BY 1""",
}
