"""Readers, sinks, catalogues, clustering and streaming on small files."""

import json

import pytest
from pyspark.sql import functions as F

from histria.functions import text as X
from histria.operators import catalog, clustering
from histria.sources import readers, sinks
from histria.streaming import events


def test_news_tables(spark, tmp_path):
    (tmp_path / "news.tsv").write_text('n1\tc\ts\tA "quoted" title\tx\tu\t[]\t[]\nn2\tc\ts\tB\t\tu\t[]\t[]\n')
    got = readers.news_items(spark, str(tmp_path / "news.tsv")).orderBy("nid").collect()
    assert [r["title"] for r in got] == ['A "quoted" title', "B"]
    (tmp_path / "behaviors.tsv").write_text("1\tu1\t11/11/2019 9:05:58 AM\tn1  n2\tp\n2\tu2\tbad\t\tp\n")
    got = {r["uid"]: r for r in readers.behaviours(spark, str(tmp_path / "behaviors.tsv")).collect()}
    assert got["u1"]["history"] == ["n1", "n2"] and got["u1"]["time"].hour == 9
    assert got["u2"]["history"] == [] and got["u2"]["time"] is None


def test_delimited_encoding_and_header(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("1::x\n".encode() and "id,title\n1,Été\n".encode("iso-8859-1"))
    got = readers.delimited(spark, str(tmp_path / "m.csv"), "item BIGINT, name STRING", encoding="ISO-8859-1").first()
    assert (got["item"], got["name"]) == (1, "Été")


def test_answers_and_ids(spark):
    df = spark.createDataFrame([('{"answer_pid": [3, 4]}',), (None,), ("{",)], "metadata string")
    assert [r["answers"] for r in readers.answers(df).collect()] == [[3, 4], [], []]
    ids = spark.createDataFrame([("7.0",), ("7",), ("x1",), ("7.5",)], "i string")
    assert [r[0] for r in ids.select(X.normal_id(F.col("i"))).collect()] == ["7", "7", "x1", "7.5"]
    lists = spark.createDataFrame([("[1, 2]",), ("1 2,3",), ("",), (None,)], "s string")
    assert [r[0] for r in lists.select(X.id_list(F.col("s"))).collect()] == [["1", "2"], ["1", "2", "3"], [], []]


def test_dates(spark):
    df = spark.createDataFrame([("Fri Nov 17 11:37:35 -0800 2017", "06 3, 2013")], "g string, a string")
    r = df.select(X.local_epoch(F.col("g")).alias("g"), X.date_words(F.col("a")).alias("a")).first()
    assert r["g"] == 1510918655 and str(r["a"]) == "2013-06-03"


def test_text(spark):
    df = spark.createDataFrame([("R&amp;B &#39;n Soul, été!", "Hello, wörld_1  x")], "t string, u string")
    r = df.select(X.clean_title(F.col("t")), X.tokens(F.col("u")), X.item_text(["t"]), X.item_text(["t", "u"])).first()
    assert r[0] == "RB n Soul été" and r[1] == ["hello", ",", "wörld_1", "x"] and r[3].startswith("t: R&amp;B")
    blank = spark.createDataFrame([("  ",)], "t string")
    assert blank.select(X.item_text(["t"])).first()[0] == "[Empty Content]"
    r = spark.createDataFrame([("sid+uid", "emb+sid+title")], "a string, b string").select(X.representation(F.col("a"), F.col("b")), X.add_ons(F.col("b"))).first()
    assert r[0] == "sid+uid+emb+title" and r[1] == "emb+title"


def test_stage_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return {"items": spark.range(3)}

    for settings in ({"n": 1}, {"n": 1}, {"n": 2}):
        assert sinks.stage(spark, str(tmp_path / "s"), settings, build)["items"].count() == 3
    assert len(calls) == 2


def test_cache_covers_keys_without_rows(spark, tmp_path):
    asked = []

    def build(keys):
        found = [r["item"] for r in keys.collect()]
        asked.append(sorted(found))
        return spark.createDataFrame([(i, 1.0) for i in found if i != 2] or [], "item long, v double")

    want = lambda *x: spark.createDataFrame([(i,) for i in x], "item long")
    folder = str(tmp_path / "c")
    assert sinks.extend_cache(spark, folder, want(1, 2), build).count() == 1
    assert sinks.extend_cache(spark, folder, want(1), build).count() == 1
    assert sinks.extend_cache(spark, folder, want(2), build).count() == 0
    assert sinks.extend_cache(spark, folder, want(2, 3), build).count() == 1
    assert asked == [[1, 2], [3]]


def test_cache_ignores_a_broken_writer(spark, tmp_path):
    want = spark.createDataFrame([(1,), (2,)], "item long")

    def broken(keys):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        sinks.extend_cache(spark, str(tmp_path / "c"), want, broken)
    rows = lambda keys: keys.withColumn("v", F.lit(1.0))
    assert sinks.extend_cache(spark, str(tmp_path / "c"), want, rows).count() == 2
    assert sinks.extend_cache(spark, str(tmp_path / "c"), want, broken).count() == 2


def test_one_writer_at_a_time(spark, tmp_path):
    folder = str(tmp_path / "w")
    with sinks.only_writer(spark, folder), pytest.raises(TimeoutError), sinks.only_writer(spark, folder):
        pass
    with sinks.only_writer(spark, folder):
        pass
    (tmp_path / "w" / "writer.lock").write_text("")
    with sinks.only_writer(spark, folder, stale_seconds=-1):
        pass
    assert not (tmp_path / "w" / "writer.lock").exists()


def test_sizes_of_stages(spark, tmp_path):
    for stage, data, n in (("raw", "a", 3), ("raw", "b", 5), ("done", "a", 7)):
        p = tmp_path / "root" / stage / data / "deep"
        p.mkdir(parents=True)
        (p / "x").write_bytes(b"z" * n)
        (p.parent / "y").write_bytes(b"z")
    got = {(r["stage"], r["data"]): (r["files"], r["bytes"]) for r in sinks.stage_sizes(spark, str(tmp_path / "root")).collect()}
    assert got == {("raw", "a"): (2, 4), ("raw", "b"): (2, 6), ("done", "a"): (2, 8)}


def test_chat_export_needs_codes_of_targets(spark):
    samples = spark.createDataFrame([(1, [1, 2], 3)], "user long, history array<long>, target long")
    codes = spark.createDataFrame([(i, [i, 0]) for i in (1, 2, 3)], "item long, codes array<int>")
    assert sinks.chat_export(samples, codes, "s", "p").count() == 1
    with pytest.raises(Exception, match="no codes for 3"):
        sinks.chat_export(samples, codes.where("item < 3"), "s", "p").collect()


def test_reports_and_statistics(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5)], "name string, x double")
    for kind in ("parquet", "csv", "json"):
        sinks.report(df, str(tmp_path / f"r.{kind}"))
    assert readers.by_suffix(spark, str(tmp_path / "r.csv"), id_col="name").first()["x"] == 1.5
    sinks.statistics(df, str(tmp_path / "s.md"))
    assert (tmp_path / "s.md").read_text() == "| name | x |\n| --- | --- |\n| a | 1.5 |\n"
    with pytest.raises(ValueError):
        sinks.report(df, str(tmp_path / "r.xlsx"))
    assert readers.readable(spark, str(tmp_path / "r.parquet")) and not readers.readable(spark, str(tmp_path / "none"))


def test_run_catalogue(spark, tmp_path):
    for data, model, lr, hr in (("d1", "m1", 0.1, 0.5), ("d1", "m2", 0.2, 0.6), ("d2", "m1", 0.1, None)):
        p = tmp_path / "runs" / data / model / "sig"
        p.mkdir(parents=True)
        (p / "meta.json").write_text(json.dumps({"config": {"data": data, "lr": str(lr)}, "test_metrics": {"hr": hr} if hr else {}, "seed": "1"}, indent=1))
    r = catalog.runs(spark, str(tmp_path / "runs"))
    assert [(x["data"], x["model"]) for x in catalog.search(r, {"data": "D1"}).collect()] == [("d1", "m1"), ("d1", "m2")]
    assert catalog.by_expressions(r, "lr=0.1000000000000001,9").count() == 2
    assert {x["field"] for x in catalog.differing(r).collect()} == {"data", "lr"}
    assert [x["key"] for x in catalog.metric_keys(r).collect()] == ["hr"]
    assert catalog.newest(r, {"model": "m1"}, "data").first()["data"] == "d2"


def test_hierarchy_is_one_tree(spark):
    v = spark.createDataFrame([(i, [float(i % 4 * 10 + i % 3), float(i)]) for i in range(40)], "item long, v array<double>")
    freq = spark.createDataFrame([(i, i % 5) for i in range(40)], "item long, freq long")
    nodes, leaves = clustering.hierarchy(v, freq, [3, 2])
    nodes, leaves = nodes.collect(), leaves.collect()
    assert len(leaves) == 40 and len({r["item"] for r in leaves}) == 40
    kids = {n["node"] for n in nodes if n["parent"] is not None}
    assert kids | {0} == {n["node"] for n in nodes} and sum(n["child_count"] for n in nodes if n["level"] == 2) == 40
    for n in {r["node"] for r in leaves}:
        assert sorted(r["leaf_label"] for r in leaves if r["node"] == n) == list(range(sum(r["node"] == n for r in leaves)))


def test_pca_is_centred(spark):
    v = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(10)], "item long, v array<double>")
    out, ratio = clustering.pca(v, 2)
    assert ratio[0] == pytest.approx(1) and sum(r["v"][0] for r in out.collect()) == pytest.approx(0, abs=1e-9)


def test_item_vectors_of_unseen_items_are_zero(spark):
    h = spark.createDataFrame([(1, [1, 2, 3])], "user long, history array<long>")
    got = {r["item"]: r["v"] for r in clustering.item_vectors(h, spark.createDataFrame([(1,), (9,)], "item long"), 4, 2).collect()}
    assert got[9] == [0.0] * 4 and any(got[1])


def test_streaming_counts_equal_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:{m:02d}:00", m % 3) for h in range(3) for m in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "t string, item int").select(F.to_timestamp("t").alias("ts"), "item")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"), "ts timestamp, item int")
    q = events.item_counts(stream, "1 hour", "1 day").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = sorted(map(tuple, events.item_counts(df, "1 hour", "1 day").collect()))
    assert sorted(map(tuple, spark.table("counts").collect())) == want
