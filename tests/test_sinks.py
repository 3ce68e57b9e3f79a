import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from shoptide.sinks import files, index, jdbc, ledger
from shoptide.sinks.tables import BatchTables, KeyedTable
from shoptide.sources import jdbc as jdbc_source
from shoptide.sources.messages import kafka_options
from shoptide.streaming.runner import held

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k string, v int")


def content(df):
    return sorted(tuple(r) for r in df.collect())


def test_keyed_table_last_write_wins_and_replay(spark, folder):
    t = KeyedTable(spark, folder, ["k"], "`k` string, `v` int")
    assert content(t.read()) == []
    assert t.upsert(rows(spark, ("a", 1), ("a", 3), ("a", 2), ("b", 1)), 0, ["v"])
    assert t.upsert(rows(spark, ("b", 5), ("c", 5)), 1)
    assert content(t.read()) == [("a", 3), ("b", 5), ("c", 5)]
    assert content(t.read(1)) == [("a", 3), ("b", 1)]
    assert not t.upsert(rows(spark, ("b", 9)), 1)
    assert content(t.read()) == [("a", 3), ("b", 5), ("c", 5)]


@pytest.mark.parametrize("by", [["k"], ["v"]])
def test_lookup_reads_the_folders_of_its_keys_only(spark, folder, by):
    t = KeyedTable(spark, folder, ["k"], "`k` string, `v` int", compact_every=3, folders=200, by=by)
    many = spark.range(2000).selectExpr("concat('k', id) as k", "cast(id as int) as v")
    for batch in range(5):
        t.upsert(many.where(f"id % 5 <> {batch}") if batch else many, batch)
    t.upsert(spark.createDataFrame([("k7", 70), ("k8", 8)], "k string, v int"), 5)
    wanted = many.where("id % 200 = 7").select(*by)
    with held(wanted):
        found = t.lookup(wanted)
        assert content(found) == sorted((f"k{i}", 70 if i == 7 and by == ["k"] else i) for i in range(7, 2000, 200))
        assert "PartitionFilters: [key_folder" in found._jdf.queryExecution().executedPlan().toString()
        stored = t.batches._stored("rows", None)
        all_files = stored.select(F.input_file_name()).distinct().count()
        touched = [r[0] for r in wanted.select(t.batches._folder("rows")).distinct().collect()]
        read = stored.where(F.col("key_folder").isin(touched)).select(F.input_file_name()).distinct().count()
        assert len(touched) <= 10 and read < all_files / 10
        assert files_read(found) == [read]


def files_read(df):
    """The numbers of files that the scans of a query that has run have read."""
    found, waiting = [], [df._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            waiting.append(node.executedPlan())
            continue
        if "QueryStage" in node.getClass().getName():
            waiting.append(node.plan())
            continue
        if node.nodeName().startswith("Scan parquet") and node.metrics().contains("numFiles"):
            found.append(node.metrics().apply("numFiles").value())
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return found


def test_keyed_table_compaction(spark, folder):
    t = KeyedTable(spark, folder, ["k"], "`k` string, `v` int", compact_every=2, keep=F.col("v") > 0)
    for batch, v in enumerate((1, 2, -3, 4, 5)):
        t.upsert(rows(spark, ("a", v), (f"k{batch}", v)), batch)
    base, batches = t.batches._committed(None)
    assert base is not None and len(batches) <= 2
    assert ("a", 5) in content(t.read()) and ("k2", -3) not in content(t.read())
    assert {k for k, _ in content(t.read())} == {"a", "k0", "k1", "k3", "k4"}


def test_batch_tables_show_whole_batches_only(spark, folder):
    t = BatchTables(spark, folder, {"x": "`k` string, `v` int", "y": "`k` string, `v` int"})
    t.commit(0, {"x": rows(spark, ("a", 1)), "y": rows(spark, ("o", 1))})
    broken = rows(spark, ("b", 1)).withColumn("v", F.raise_error(F.lit("stop")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        t.commit(1, {"x": rows(spark, ("b", 2)), "y": broken})
    assert content(t.read("x")) == [("a", 1, 0)] and content(t.read("y")) == [("o", 1, 0)]
    t.commit(1, {"x": rows(spark, ("b", 2)), "y": rows(spark, ("o", 2))})
    assert content(t.read("x")) == [("a", 1, 0), ("b", 2, 1)]


def test_index(spark, folder):
    store = index.index_store(spark, folder)
    index.index_upsert(store, rows(spark, ("a", 1), ("b", 1)), "docs", 0, F.lit("2020-01-01"), "k")
    index.index_upsert(store, rows(spark, ("a", 2)), "docs", 1, F.lit("2020-01-01"), "k")
    index.index_upsert(store, rows(spark, ("a", 3)), "docs", 2, F.lit("2020-01-02"), "k")
    index.index_upsert(store, rows(spark, ("x", 1), ("x", 1)), "docs", 3, F.lit("2020-01-02"))
    docs = store.read().collect()
    named = {(d.index_name, d.doc_id): json.loads(d.source)["v"] for d in docs if len(d.doc_id) == 1}
    assert named == {("docs_2020-01-01", "a"): 2, ("docs_2020-01-01", "b"): 1, ("docs_2020-01-02", "a"): 3}
    assert sum(len(d.doc_id) == 36 for d in docs) == 2


def test_offsets(spark, folder):
    table = ledger.ledger_table(spark, folder)
    read = spark.createDataFrame([("t", 0, 5), ("t", 0, 7), ("t", 1, 2), ("u", 0, 9)], "topic string, partition int, offset bigint")
    ledger.save_offsets(table, read, "g", 0)
    ledger.save_offsets(table, read.where("topic = 't' AND partition = 1").withColumn("offset", F.lit(40)), "g", 1)
    maps = ledger.to_topic_maps(table.read())
    assert {r.topic: json.loads(r.offsets) for r in maps.collect()} == {"t": {"0": "8", "1": "41"}, "u": {"0": "10"}}
    assert content(ledger.from_topic_maps(maps)) == content(table.read())
    assert content(ledger.read_offsets(table, "g", ["u"])) == [("g", "u", 0, 10)]


def test_kafka_options():
    options = kafka_options("h:1", ["b", "a"], per_trigger=10)
    assert options["subscribe"] == "a,b" and options["startingOffsets"] == "earliest" and options["maxOffsetsPerTrigger"] == "10"
    assert kafka_options("h:1", ["a"], '{"a":{"0":3}}')["startingOffsets"] == '{"a":{"0":3}}'


def test_later_batches_replace_rows_of_the_same_key(spark, folder):
    t = BatchTables(spark, folder, {"x": "`k` string, `v` int", "y": "`k` string, `v` int"}, {"x": ["k"], "y": ["k"]}, compact_every=2)
    for batch in range(6):
        t.commit(batch, {"x": rows(spark, ("a", batch), (f"k{batch}", batch)), "y": rows(spark, ("read", batch))})
        t.commit(batch, {"x": rows(spark, ("a", 99)), "y": rows(spark, ("read", 99))})
        assert content(t.current("x")) == sorted([("a", batch), *((f"k{b}", b) for b in range(batch + 1))])
        assert content(t.current("y")) == [("read", batch)]
    assert content(t.current("x", None, spark.createDataFrame([("k1",), ("zz",)], "k string"))) == [("k1", 1)]
    assert content(t.current("x", 3, spark.createDataFrame([("a",)], "k string"))) == [("a", 2)]


def test_tables_belong_to_one_query(spark, folder):
    t = BatchTables(spark, folder, {"x": "`k` string, `v` int"})

    def run(checkpoint):
        stream = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", "1").load()
        stream.writeStream.foreachBatch(lambda _, batch: t.commit(batch, {"x": rows(spark, ("a", batch))})).option(
            "checkpointLocation", f"{folder}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()

    run("one")
    run("one")
    before = t.read("x").count()
    with pytest.raises(Exception, match="belongs to the streaming query"):
        run("two")
    assert t.read("x").count() == before > 0


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(spark.sparkContext, "master", "spark://host:7077")
        assert files.shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
        m.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            files.shared_folder(spark)


def test_plan_of_a_lookup_restricts_before_it_ranks(spark, folder):
    t = KeyedTable(spark, folder, ["k"], "`k` string, `v` int")
    for batch in range(3):
        t.upsert(rows(spark, ("a", batch), ("b", batch)), batch)
    plan = t.lookup(spark.createDataFrame([("a",)], "k string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("LeftSemi")


@pytest.fixture
def database(spark, request):
    """An in-memory database inside the session's own process."""
    url = f"jdbc:derby:memory:{request.node.name}"
    jdbc.execute(spark, url + ";create=true", DERBY, [
        "CREATE TABLE tm_amount (stat_time VARCHAR(19), tm_id BIGINT, tm_name VARCHAR(40), amount DECIMAL(26,2))",
        "CREATE TABLE tm_amount_stage (stat_time VARCHAR(19), tm_id BIGINT, tm_name VARCHAR(40), amount DECIMAL(26,2), batch_id BIGINT)",
        "CREATE TABLE ads_offset (group_id VARCHAR(40), topic VARCHAR(40), partition_id INT, partition_offset BIGINT)",
        "CREATE TABLE ads_offset_stage (group_id VARCHAR(40), topic VARCHAR(40), partition_id INT, partition_offset BIGINT, batch_id BIGINT)",
    ])
    return url


AMOUNTS = jdbc.Target("tm_amount", "tm_amount_stage", ("stat_time", "tm_id"), ("stat_time", "tm_id", "tm_name", "amount"))
OFFSETS = jdbc.Target("ads_offset", "ads_offset_stage", ("group_id", "topic", "partition_id"), ("group_id", "topic", "partition_id", "partition_offset"))


def test_result_and_offsets_in_one_transaction(spark, database):
    def batch(number, amount, offset, fail=False):
        a = spark.sql(f"SELECT '2021-01-01 00:00:00' stat_time, 1L tm_id, 'x' tm_name, cast({amount} AS decimal(26,2)) amount")
        o = spark.sql(f"SELECT 'g' group_id, 't' topic, 0 partition_id, {offset}L partition_offset")
        target = OFFSETS if not fail else replace(OFFSETS, table="missing")
        jdbc.replace_in_one_transaction(number, [(a, AMOUNTS), (o, target)], database, DERBY)

    def state():
        return (content(jdbc_source.read_table(spark, database, "tm_amount", driver=DERBY).select("tm_id", F.col("amount").cast("double"))),
                content(jdbc_source.read_query(spark, database, "SELECT partition_offset FROM ads_offset WHERE group_id = 'g'", driver=DERBY)))

    batch(0, "1.50", 10)
    assert state() == ([(1, 1.5)], [(10,)])
    batch(1, "2.50", 20)
    batch(1, "2.50", 20)
    assert state() == ([(1, 2.5)], [(20,)])
    with pytest.raises(Exception):
        batch(2, "9.99", 30, fail=True)
    assert state() == ([(1, 2.5)], [(20,)])
    assert jdbc_source.read_table(spark, database, "tm_amount_stage", driver=DERBY).where("batch_id < 2").count() == 0


def test_jdbc_append_and_views(spark, database):
    df = spark.sql("SELECT 'g' group_id, 't' topic, cast(id AS int) partition_id, id partition_offset FROM range(300)")
    jdbc.append(df, database, "ads_offset", driver=DERBY)
    jdbc_source.register(spark, database, {"offs": "ads_offset"}, driver=DERBY)
    assert spark.sql("SELECT count(*) n, max(partition_offset) m FROM offs").first().asDict() == {"n": 300, "m": 299}
    split = jdbc_source.read_table(spark, database, "ads_offset", "PARTITION_ID", (0, 300), 3, driver=DERBY)
    assert split.rdd.getNumPartitions() == 3 and split.count() == 300


def test_merged_batches_leave_the_disk(spark, folder):
    t = KeyedTable(spark, folder, ["k"], "`k` string, `v` int", compact_every=2)
    for batch in range(9):
        t.upsert(rows(spark, ("a", batch), (f"k{batch}", batch)), batch)
        assert ("a", batch) in content(t.read()) and len(content(t.read())) == batch + 2
    marks = files.children(spark, f"{folder}/commits")
    assert len(marks) <= 6 and len(files.children(spark, f"{folder}/data/rows")) == len(marks)
