"""Writes with conditions, feeds and stream guards."""

import threading
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from sievework.functions.text import bigrams, jaccard
from sievework.plans.review import name_error, name_key, override_targets, prefix_discounted
from sievework.sources.feeds import indexed, json_log, read_word_documents, written_document
from sievework.sources.shared import drop_path, new_path, shared_dir
from sievework.sources.sinks import Conflict, VersionedTable
from sievework.streaming.guards import single_flight, waited
from sievework.streaming.leases import table_stream

SF = "/root/testdata/sf0.001"


def test_versions_are_swapped_once(spark):
    table = VersionedTable(spark, new_path(spark, "t"), "id")
    rows = lambda *r: spark.createDataFrame(r, "id long, until long")
    assert table.version() == 0 and table.write(rows((1, 5), (2, 50)), 0) == 1
    version, outcome = table.upsert(rows((1, 99), (2, 99), (3, 99)), F.expr("held.until < 10"))
    assert version == 2 and {tuple(r) for r in outcome.collect()} == {(1, "updated"), (2, "refused"), (3, "inserted")}
    assert {tuple(r) for r in table.read(2).collect()} == {(1, 99), (2, 50), (3, 99)}
    with pytest.raises(Conflict):
        table.write(rows((9, 9)), 1)
    assert {r.id for r in table.read(table.delete(rows((2, 0)))).collect()} == {1, 3}


def test_versions_survive_dead_and_slow_writers(spark):
    table = VersionedTable(spark, new_path(spark, "t"), "id")
    rows = lambda n: spark.createDataFrame([(n,)], "id long")
    table.write(rows(1), 0)
    # a writer dies while it writes version 2: parts without Spark's marker
    rows(66).write.parquet(f"{table.path}/v2/dead")
    drop_path(spark, f"{table.path}/v2/dead/_SUCCESS")
    assert table.version() == 1 and table.write(rows(2), 1) == 2
    # of writers that start from one version, one wins
    outcomes = []

    def run(n):
        try:
            outcomes.append((n, table.write(rows(n), 2)))
        except Conflict:
            outcomes.append((n, None))

    threads = [threading.Thread(target=run, args=(n,)) for n in range(10, 14)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [n for n, version in outcomes if version == 3]
    assert len(won) == 1 and len(outcomes) == 4 and [r.id for r in table.read(3).collect()] == won and table.version() == 3


def test_logs_abort_at_a_bad_line(spark):
    path = new_path(spark, "log")
    spark.createDataFrame([('{"id": 1}',), ("{broken",)], "value string").write.text(path)
    with pytest.raises(Exception, match="FAILED_READ_FILE|MALFORMED"):
        json_log(spark, path, "id long").collect()


def test_indexed_marks_keys(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("",)], "key string")
    assert sorted((r.key or "-", r.error or "") for r in indexed(rows, "key").collect()) == [("-", "missing"), ("-", "missing"), ("a", ""), ("b", "repeated"), ("b", "repeated")]


def test_word_documents(spark):
    files = spark.createDataFrame([(1, written_document(["Head", "", "a & b <c>"])), (2, written_document([]))], "id long, content binary")
    assert [tuple(r) for r in read_word_documents(files).collect()] == [(1, 0, "Heading1", "Head"), (1, 1, "", "a & b <c>")]


def test_names(spark):
    rows = spark.createDataFrame([("Ｔｈｅ Ｎｅｗｓ", "thenews"), ("STRASSE-Zeitung", "Straße Zeitung"), ("Unknown", None), (None, None), ("--", None), ("Other", "this")], "name string, family string")
    got = [tuple(r) for r in rows.select(name_key(F.col("name")), name_error(F.col("name"), F.col("family"))).collect()]
    assert got == [("thenews", None), ("strassezeitung", None), ("unknown", "generic"), (None, "missing"), ("", "missing"), ("other", "mismatch")]


def test_overrides_take_each_row_once(spark):
    rows = spark.createDataFrame([("kz", 1, 11, "Energy prices rise"), ("kz", 2, 12, "Energy prices rise"), ("kz", 3, 13, "Other story entirely")], "block string, place int, id long, title string")
    asked = spark.createDataFrame([("kz", 1, 1, "energy prices"), ("kz", 2, 1, "Energy prices rise!"), ("kz", 3, 9, "Energy prices rise"), ("kz", 4, 3, "Unlike")], "block string, nth long, place int, title string")
    assert {tuple(r) for r in override_targets(asked, rows).collect()} == {("kz", 1, 11), ("kz", 2, 12)}


def test_prefix_is_discounted(spark):
    rows = spark.createDataFrame([("presidential1 trade grows", "presidential2 roads open"), ("same", "same"), ("abcd", "abcd x"), ("a", "b")], "a string, b string")
    plain, fair = zip(*((r.p, r.f) for r in rows.select(jaccard(bigrams(F.col("a")), bigrams(F.col("b"))).alias("p"), prefix_discounted(F.col("a"), F.col("b")).alias("f")).collect()), strict=True)
    assert fair[0] < plain[0] and fair[1] == 1.0 and fair[3] == 0.0 and 0 < fair[2] < 1


def test_single_flight_and_deadlines(spark):
    slow = table_stream(spark, f"{SF}/events.parquet").withColumn("x", F.expr("reflect('java.lang.Thread', 'getAllStackTraces')"))
    top = new_path(spark, "guard")
    writer = lambda k: slow.writeStream.format("parquet").option("path", f"{top}/{k}/out").option("checkpointLocation", f"{top}/{k}/state")
    run = single_flight(spark, "guarded", writer(1))
    assert run is not None and (single_flight(spark, "guarded", writer(2)) is None or not run.isActive)
    warned = []
    assert waited(run, 0.001, 120, lambda: warned.append(1)) in ("late", "done")
    again = single_flight(spark, "guarded", writer(1))
    assert again is not None and waited(again, 60, 120) == "done"


def test_a_cluster_needs_a_shared_folder(spark):
    class Session:
        def __init__(self, master, folder=None):
            self.sparkContext, self.conf = SimpleNamespace(master=master), SimpleNamespace(get=lambda _, __: folder)

    assert shared_dir(Session("local[8]")).startswith("file:///tmp/") and shared_dir(Session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(ValueError):
        shared_dir(Session("spark://host:7077"))
