"""Queries over tables of counts, topics and pairs of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.vectors import doubles
from skein.operators import discussion, stats, topics
from skein.operators.motion import MOTIONS
from skein.plans import cloud_queries, series_queries
from skein.session import cut
from skein.sources.tables import table
from skein.sources.views import cloud, threads

#: Kinds of events, as columns of contingency tables.
KINDS = ["click", "error", "purchase", "signup", "view"]


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("bucket", F.col("user_id") % 4)


def contingency(spark: SparkSession, d: str) -> DataFrame:
    """Test of independence of bucket and kind of event."""
    t = stats.independence(_events(spark, d), "bucket", "event_type")
    return t.select(F.round("chi2", 4).alias("chi2"), "dof", F.round("cramers_v", 6).alias("cramers_v"), "n", "verdict")


def contingency_p(spark: SparkSession, d: str) -> DataFrame:
    return stats.independence(_events(spark, d), "bucket", "event_type").select(F.round("p", 6).alias("p"))


def contingency_of_motions(spark: SparkSession, d: str) -> DataFrame:
    """Test of independence of side and dominant motion."""
    t = stats.independence(series_queries._weights(spark, d), "side", "dominant_motion")
    return t.select(F.round("chi2", 4).alias("chi2"), "dof", F.round("cramers_v", 6).alias("cramers_v"), "n", "verdict")


def association_cells(spark: SparkSession, d: str) -> DataFrame:
    """Each bucket and kind: shares, expected count, residual."""
    a = stats.association(_events(spark, d), "bucket", "event_type", KINDS)
    r = lambda c: F.round(c, 6).alias(c)
    return a.select("bucket", "event_type", "count", "row_size", r("share"), r("baseline"), r("expected"), r("residual"), r("odds_ratio"))


def association_tests(spark: SparkSession, d: str) -> DataFrame:
    a = stats.association(_events(spark, d), "bucket", "event_type", KINDS)
    return a.select("bucket", "event_type", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"), "flag")


def fisher_cells(spark: SparkSession, d: str) -> DataFrame:
    return stats.fisher_cells(_events(spark, d), "event_type", "bucket").withColumn("p", F.round("p", 6))


def bh_qvalues(spark: SparkSession, d: str) -> DataFrame:
    """Benjamini-Hochberg over a p for each supplier."""
    p = table(spark, d, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 37 % 1009 + 1) / F.lit(1010.0)).alias("p"))
    return stats.bh(p, "p", [F.col("s_suppkey")]).select("s_suppkey", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


def anisotropy(spark: SparkSession, d: str) -> DataFrame:
    a = stats.anisotropy(cloud(spark, d))
    return a.select(F.round("overall", 6).alias("overall"), F.round("within", 6).alias("within"), "anisotropy")


def cosine_quantiles(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("thread_id"), "vec_id", doubles(F.col("embedding")).alias("e"))
    return stats.cosine_quantiles(v, "vec_id")


def _titles(spark: SparkSession, d: str, dim: int = 64) -> DataFrame:
    t = threads(spark, d).select(F.col("post_id").alias("id"), F.col("title").alias("text"), "title", "subreddit")
    return discussion.hash_vectors(t, dim).withColumnRenamed("id", "thread_id")


def exemplars(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "label", doubles(F.col("embedding")).alias("e"))
    return stats.exemplars(v, "label", "vec_id").select("label", "vec_id", F.round("cos", 6).alias("cos"), "rank")


def title_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics of titles by spherical k-means with the best number of clusters."""
    return topics.topics(_titles(spark, d))[0]


def topic_search(spark: SparkSession, d: str) -> DataFrame:
    """Silhouette of each number of clusters tried."""
    found = topics.topics(_titles(spark, d))[1]
    rows = [(s["k"], s["n_clusters"], min(s["sizes"]), s["silhouette"]) for s in found]
    return spark.createDataFrame(rows, "k long, n_clusters long, least long, silhouette double")


def linkage_topics(spark: SparkSession, d: str) -> DataFrame:
    """Average linkage over the vectors of the labels' exemplars."""
    v = table(spark, d, "embeddings").select("vec_id", "label", doubles(F.col("embedding")).alias("e"))
    near = stats.exemplars(v, "label", "vec_id", 20).select("vec_id").join(v, "vec_id")
    return topics.choose_linkage(near.select("vec_id", "e"), "vec_id", 5, 12)[0].select("vec_id", "cluster")


def tfidf_keywords(spark: SparkSession, d: str) -> DataFrame:
    t = threads(spark, d).filter("subreddit is not null").select(F.col("post_id").alias("thread_id"), "title", "subreddit")
    return topics.keywords(t, "subreddit", most=1_000_000).select("subreddit", "term", F.round("lead", 6).alias("lead"), "rank")


def topic_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Weights of both sides by a topic that both share: the thread's number modulo 5."""
    w = series_queries._weights(spark, d)
    shared = w.select("thread_id", (F.col("thread_id") % 5).cast("string").alias("cluster_id")).distinct()
    t = topics.topic_weights(w, shared)
    return t.select("cluster_id", "motion", "n_human", "n_sim", "n_pairs", F.round("mean_human", 6).alias("mean_human"), F.round("mass_sim", 6).alias("mass_sim"), F.round("delta_pp", 6).alias("delta_pp"), "n_positive")


def topic_variation(spark: SparkSession, d: str) -> DataFrame:
    w = series_queries._weights(spark, d).withColumn("cluster_id", (F.col("thread_id") % 5).cast("string"))
    return topics.total_variation(w, ["cluster_id"]).select("cluster_id", "n", F.round("mean_total_variation", 6).alias("mean_total_variation"))


def separation_ranking(spark: SparkSession, d: str) -> DataFrame:
    """How far four measures part the two sides of clouds, by |d|."""
    from skein.operators.describe import cohens_d

    w = cut(cloud_queries._paired(spark, d), "paired")
    return cohens_d(w, "side", "sim", "human", ["m_leave", "d_sigma", "d_dim", "chi_step_mean"]).orderBy(F.desc(F.abs("d")))


NAMES = (
    "contingency contingency_p contingency_of_motions association_cells association_tests fisher_cells bh_qvalues anisotropy cosine_quantiles exemplars title_topics "
    "topic_search linkage_topics tfidf_keywords topic_rollup topic_variation separation_ranking"
).split()
QUERIES = {n: globals()[n] for n in NAMES}

_FLAT = """WITH cloud AS (SELECT vec_id // 100 AS thread_id, embedding FROM embeddings),
flat AS (SELECT thread_id, unnest(generate_series(1, len(embedding))) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM cloud)"""


def _chi2(t: str, r: str, c: str) -> str:
    return f""",
t AS (SELECT {r} AS r, {c} AS c, count(*) AS o FROM {t} GROUP BY 1, 2), rs AS (SELECT r, sum(o) AS rt FROM t GROUP BY 1), csum AS (SELECT c, sum(o) AS ct FROM t GROUP BY 1),
x AS (SELECT rs.r, csum.c, coalesce(o, 0) AS o, CAST(rt AS DOUBLE) * ct / (SELECT sum(o) FROM t) AS e, rt, ct FROM rs CROSS JOIN csum LEFT JOIN t ON t.r = rs.r AND t.c = csum.c),
k AS (SELECT sum((o - e) * (o - e) / e) AS chi2, count(DISTINCT r) AS nr, count(DISTINCT c) AS nc, CAST(sum(o) AS BIGINT) AS n FROM x)
"""


_TEST = "SELECT round(chi2, 4) AS chi2, (nr - 1) * (nc - 1) AS dof, round(sqrt(chi2 / (n * (least(nr, nc) - 1))), 6) AS cramers_v, n, 'tested' AS verdict FROM k"
_EV = "WITH ev AS (SELECT event_type, user_id % 4 AS bucket FROM events)"
_STOP = "(" + ", ".join(f"'{w}'" for w in topics.STOP_WORDS) + ")"
_ROLL = series_queries._W + """,
pr AS (SELECT thread_id % 5 AS g, motion, thread_id, max(wg) FILTER (side = 'human') AS h, max(wg) FILTER (side = 'sim') AS s FROM wt GROUP BY 1, 2, 3)"""
ORACLES = {
    "contingency": _EV + _chi2("ev", "bucket", "event_type") + _TEST,
    "contingency_of_motions": series_queries._W + ", dm AS (SELECT thread_id, side, arg_min(motion, {'w': -c, 'k': k}) AS m FROM wt GROUP BY 1, 2)" + _chi2("dm", "side", "m") + _TEST,
    "association_cells": _EV + _chi2("ev", "bucket", "event_type") + """SELECT r AS bucket, c AS event_type, CAST(o AS BIGINT) AS count, CAST(rt AS BIGINT) AS row_size, round(o / rt, 6) AS share,
  round(ct / n, 6) AS baseline, round(e, 6) AS expected, round((o - e) / sqrt(e), 6) AS residual, round(CASE WHEN (rt - o) * (ct - o) > 0 THEN CAST(o AS DOUBLE) * (n - rt - ct + o) / ((rt - o) * (ct - o)) END, 6) AS odds_ratio FROM x, k""",
    "bh_qvalues": """
WITH p AS (SELECT s_suppkey, (s_suppkey * 37 % 1009 + 1) / 1010.0 AS p FROM supplier), r AS (SELECT *, row_number() OVER (ORDER BY p, s_suppkey) AS k, count(*) OVER () AS n FROM p)
SELECT s_suppkey, round(CAST(p AS DOUBLE), 6) AS p, round(least(1.0, min(CAST(p AS DOUBLE) * n / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r""",
    "anisotropy": _FLAT + """,
o AS (SELECT thread_id, sum(s * s) AS q, max(n) AS n FROM (SELECT thread_id, d, sum(x) AS s, count(*) AS n FROM flat GROUP BY ALL) t GROUP BY 1),
a AS (SELECT sum(s * s) AS q, max(n) AS n FROM (SELECT d, sum(x) AS s, count(*) AS n FROM flat GROUP BY ALL) t),
r AS (SELECT (a.q - a.n) / (a.n * (a.n - 1)) AS overall, (SELECT sum(q - n) / sum(n * (n - 1)) FROM o) AS within FROM a)
SELECT round(overall, 6) AS overall, round(within, 6) AS within, CASE WHEN overall > 0.3 THEN 'strong' WHEN overall > 0.1 THEN 'mild' ELSE 'none' END AS anisotropy FROM r""",
    "exemplars": """
WITH flat AS (SELECT vec_id, label, unnest(generate_series(1, len(embedding))) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
m AS (SELECT label, d, avg(x) AS m FROM flat GROUP BY ALL), l AS (SELECT label, sqrt(sum(m * m)) AS l FROM m GROUP BY 1),
c AS (SELECT vec_id, label, sum(x * m) / max(l) AS cos FROM flat JOIN m USING (label, d) JOIN l USING (label) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY cos DESC, vec_id) AS INTEGER) AS rank FROM c)
SELECT label, vec_id, round(cos, 6) AS cos, rank FROM r WHERE rank <= 3""",
    "tfidf_keywords": rf"""
WITH th AS (SELECT post_id, title, subreddit FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY retrieved_at DESC) AS r FROM threads) WHERE r = 1 AND subreddit IS NOT NULL AND title IS NOT NULL),
w AS (SELECT post_id, subreddit AS s, list_filter(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda x: x NOT IN {_STOP}) AS w FROM th),
g AS (SELECT post_id, s, unnest(w) AS term FROM w UNION ALL SELECT post_id, s, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM w WHERE len(w) > 1),
tf AS (SELECT post_id, s, term, count(*) AS tf FROM g GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM w),
x AS (SELECT tf.*, tf * (ln((1 + n) / (1 + df)) + 1) AS v FROM tf JOIN df USING (term), n),
l AS (SELECT post_id, sqrt(sum(v * v)) AS l FROM x GROUP BY 1), m AS (SELECT s, term, sum(v / l) AS v FROM x JOIN l USING (post_id) GROUP BY 1, 2),
c AS (SELECT s, count(*) AS c FROM w GROUP BY 1), a AS (SELECT term, sum(v) AS a FROM m GROUP BY 1),
d AS (SELECT s, term, v / c - a / n AS lead FROM m JOIN c USING (s) JOIN a USING (term), n WHERE NOT regexp_matches(term, '^[0-9]+$')),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY round(lead, 9) DESC, term) AS rank FROM d)
SELECT s AS subreddit, term, round(lead, 6) AS lead, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""",
    "topic_rollup": _ROLL + """ SELECT CAST(g AS VARCHAR) AS cluster_id, motion, count(h) AS n_human, count(s) AS n_sim, count(h - s) AS n_pairs, round(avg(h), 6) AS mean_human, round(coalesce(sum(s), 0), 6) AS mass_sim,
  round(100 * avg(s - h), 6) AS delta_pp, count(*) FILTER (s > h) AS n_positive FROM pr GROUP BY 1, 2""",
    "topic_variation": _ROLL + ", v AS (SELECT g, thread_id, sum(abs(s - h)) / 2 AS v FROM pr GROUP BY 1, 2) SELECT CAST(g AS VARCHAR) AS cluster_id, count(v) AS n, round(avg(v), 6) AS mean_total_variation FROM v GROUP BY 1",
}
