import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators.discussion import hash_vectors
from skein.sources import embedders, settings, stores
from skein.sources.readers import raw_lines, replay, resume_at, simulations, strict_json, thread_by_id
from skein.streaming.files import append_once, dump_stream, fingerprint, resumable_turns, upsert


def test_strict_json_names_the_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('﻿{"x": 1}\n\n{"x": 2}\n')
    assert sorted(r.x for r in strict_json(spark, str(tmp_path / "a.jsonl"), "x long").collect()) == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n{"x": \n')
    with pytest.raises(ValueError, match=r"b\.jsonl:2: invalid JSON"):
        strict_json(spark, str(tmp_path / "b.jsonl"), "x long")


def test_lines_lookups_and_documents(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"post": {"id": "p"}, "comments": [{"id": "a", "body": "x"}]}\n\n{"post": {"id": "q"}, "comments": [{"id": "b", "body": "y"}]}\n')
    assert raw_lines(spark, str(tmp_path / "d.jsonl")).count() == 2
    assert thread_by_id(spark, str(tmp_path / "d.jsonl"), "q").first().comments[0].id == "b"
    assert thread_by_id(spark, str(tmp_path / "d.jsonl"), "z").count() == 0
    (tmp_path / "sims" / "deep").mkdir(parents=True)
    (tmp_path / "sims" / "deep" / "one.json").write_text('{\n "post_id": "p"\n}')
    assert [r.post_id for r in simulations(spark, str(tmp_path / "sims"), "post_id string").collect()] == ["p"]


def test_replay_goes_on_where_it_stopped(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"type": "meta", "post_id": "p", "n_turns": 4}\n{"position": 0, "body": "a"}\n{"position": 1, "body": "b"}\n{"position": 3, "body": "d"}\n{"positi')
    (tmp_path / "q.jsonl").write_text('{"type": "meta", "post_id": "q", "n_turns": 1}\n{"position": 0, "body": "a"}\n')
    heads, turns = replay(spark, str(tmp_path))
    got = {r.file_id: (r.n_done, r.n_turns, r.next) for r in resume_at(heads, turns).collect()}
    assert got == {"p": (2, 4, 2), "q": (1, 1, None)}


CALLS = "spark.sql.shuffle.partitions"


def test_providers():
    assert embedders.build({"backend": "smoke", "hash_dim": 8}).embed(["same words"]).shape == (1, 8)
    assert np.allclose(np.linalg.norm(embedders.embed_one(embedders.HashingEmbedder(300), "a b c")), 1)
    assert not embedders.HashingEmbedder(4).embed([""]).any()
    with pytest.raises(ValueError):
        embedders.build({"backend": "nothing"})
    batches = []

    def call(texts):
        batches.append(len(texts))
        return [(k, [float(len(t)), 0.0]) for k, t in reversed(list(enumerate(texts)))]

    got = embedders.BatchEmbedder(call, "remote", 2).embed(["a", "bb", "ccc"])
    assert batches == [2, 1] and np.allclose(got, [[1, 0]] * 3)
    with pytest.raises(ValueError):
        embedders.BatchEmbedder(lambda t: [], "remote").embed(["a"])


def test_hashing_is_the_same_in_columns_and_arrays(spark):
    texts = ["One two two", "Straße ÜBER x y", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for dim in (8, 300):
        want = embedders.HashingEmbedder(dim).embed([t or "" for t in texts])
        got = {r.id: r.e for r in hash_vectors(df, dim).collect()}
        assert all(np.allclose(got[k], want[k], atol=1e-6) for k in range(4))


def test_vectors_are_reused_by_content(spark, tmp_path):
    schema = "post_id string, side string, pos long, comment_id string, body string"
    cfg = {"backend": "hashing", "hash_dim": 16}
    rows = spark.createDataFrame([(p, s, k, f"{p}{k}", f"text {p} {s} {k}") for p in "ab" for s in ("human", "sim") for k in range(3)], schema)
    first = stores.vectors_of(rows, cfg)
    assert {r.origin for r in first.collect()} == {"embedded"}
    stores.save_vectors(first, str(tmp_path / "v"))
    kept = stores.load_vectors(spark, str(tmp_path / "v"))
    edited = rows.withColumn("body", F.when((F.col("post_id") == "a") & (F.col("side") == "sim") & (F.col("pos") == 1), "new").otherwise(F.col("body")))
    got = stores.vectors_of(edited, cfg, kept, stores.seeds(kept.filter("side = 'human'"))).collect()
    assert {(r.post_id, r.side): r.origin for r in got} == {("a", "human"): "stored", ("a", "sim"): "embedded", ("b", "human"): "stored", ("b", "sim"): "stored"}
    shorter = stores.vectors_of(rows.filter("pos < 2"), cfg, kept).collect()
    assert {r.origin for r in shorter} == {"embedded"}
    seeded = stores.vectors_of(rows, cfg, None, stores.seeds(kept.filter("side = 'human' and pos = 0"))).collect()
    assert {(r.side, r.pos) for r in seeded if r.origin == "seeded"} == {("human", 0)} and len(seeded) == 12
    with pytest.raises(ValueError, match="another embedder"):
        stores.vectors_of(rows, {"backend": "hashing", "hash_dim": 8}, None, stores.seeds(kept))


def test_means_and_sinks(spark, tmp_path):
    stores.save_mean(spark.createDataFrame([([0.5, 0.25],)], "mu array<double>"), str(tmp_path / "mu.npy"))
    assert stores.reference_mean(spark, str(tmp_path / "mu.npy"), 2).first().mu == [0.5, 0.25]
    with pytest.raises(ValueError):
        stores.reference_mean(spark, str(tmp_path / "mu.npy"), 3)
    good = spark.createDataFrame([(1.0, [1.0])], "x double, y array<double>")
    stores.save_strict_json(good, str(tmp_path / "out"), {"n": 1}, str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text()) == {"n": 1} and spark.read.json(str(tmp_path / "out")).count() == 1
    for bad in (spark.createDataFrame([(float("nan"), [1.0])], "x double, y array<double>"), spark.createDataFrame([(1.0, [float("inf")])], "x double, y array<double>")):
        with pytest.raises(ValueError):
            stores.save_strict_json(bad, str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()


def test_settings(tmp_path):
    (tmp_path / "configs").mkdir()
    (tmp_path / "configs" / "a.json").write_text('{"threads_path": "../d.zst", "outputs": "out", "title_embedding": {"hash_dim": 64, "device": null}}')
    s = settings.load(str(tmp_path / "configs" / "a.json"), {"SKEIN_USER_HISTORY": "/h.zst"})
    assert s.threads_path == str((tmp_path.parent / "d.zst").resolve()) and s.user_history_path == "/h.zst" and s.outputs == str(tmp_path / "out")
    assert settings.title_settings(s)["hash_dim"] == 64 and settings.title_settings(s, "smoke")["backend"] == "smoke"
    with pytest.raises(ValueError):
        settings.title_settings(settings.changed(s, embedding={"device": "cuda"}))
    for bad in ({"window_size": 0}, {"low_quantile": 0.9}, {"window_pool": "x"}):
        with pytest.raises(ValueError):
            settings.changed(s, **bad)
    (tmp_path / "configs" / "b.json").write_text('{"colour": 1}')
    with pytest.raises(ValueError):
        settings.load(str(tmp_path / "configs" / "b.json"), {})


def test_file_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.jsonl").write_text('{"post": {"id": "p%d"}, "comments": []}\n{"post": {"id": "p%d"}, "comments": []}\n' % (k, k))
    stream = dump_stream(spark, str(tmp_path / "in")).select(F.col("post.id").alias("id"))
    for _ in range(2):  # the second run finds nothing new
        append_once(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "id").awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["p0", "p1", "p2"]


def test_results_are_kept_by_content(spark, tmp_path):
    path, made = str(tmp_path / "kept"), []

    def compute(df):
        made.append(sorted(r.k for r in df.collect()))
        return df.select("k", "print", F.length("text").alias("n"))

    def run(texts, n, setting="s"):
        fresh = spark.createDataFrame(texts, "k string, text string").withColumn("print", fingerprint(setting, "text"))
        return {r.k: r.n for r in upsert(spark, path, fresh, "k", compute, n).collect()}

    assert run([("a", "xx"), ("b", "y")], 0) == {"a": 2, "b": 1}
    assert run([("a", "xx"), ("b", "yyy"), ("c", "")], 1) == {"a": 2, "b": 3, "c": 0}
    assert run([("a", "xx")], 2, "t") == {"a": 2}
    assert made == [["a", "b"], ["b", "c"], ["a"]]


def test_generation_goes_on_in_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", 2), ("b", 1)], "key string, n long").coalesce(1).write.parquet(str(tmp_path / "in" / "x=1"))
    stream = spark.readStream.schema("key string, n long").parquet(str(tmp_path / "in" / "x=*"))

    def go(name):
        q = resumable_turns(stream, lambda key, k: f"{key}{k}").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append")
        q.trigger(availableNow=True).start().awaitTermination(90)

    go("a")
    spark.createDataFrame([("a", 4)], "key string, n long").coalesce(1).write.parquet(str(tmp_path / "in" / "x=2"))
    go("b")
    assert sorted(r.body for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a0", "a1", "a2", "a3", "b0"]
