"""Envelopes, typed rows, dimensions and facts on hand-made rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from shoptide.functions.entities import order_times, parse_lenient, parse_strict, to_value
from shoptide.operators import dau, dim, dwd, dws, ods
from shoptide.schemas import ORDER_DETAIL, ORDER_INFO, SKU_INFO, ddl, names
from shoptide.plans.queries import with_no_dimensions, with_no_sku
from shoptide.streaming.runner import held


def messages(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_array_envelope(spark):
    df = messages(
        spark,
        '{"table":"ORDER_INFO","type":"INSERT","data":[{"id":"1"},{"id":"2"}]}',
        '{"table":"order_info","type":"update","data":[{"id":"3"}]}',
        '{"table":"order_detail","type":"update","data":[{"id":"4","price":12345678901234}]}',
        '{"table":"order_detail","type":"bootstrap-insert","data":[{"id":"5"}]}',
        '{"table":"sku_info","type":"delete","data":[{"id":"6"}]}',
        '{"table":"other","type":"insert","data":[{"id":"7"}]}',
        '{"table":"sku_info","type":"insert","data":[]}',
        '{"table":"sku_info","type":"insert","data":null}',
        '{"table":"sku_info","ty',
    )
    got = sorted((r.topic, r.value) for r in ods.route(ods.parse_array(df), ods.ARRAY_OPS).collect())
    assert got == [("ods_order_detail", '{"id":"4","price":12345678901234}'), ("ods_order_info", '{"id":"1"}'), ("ods_order_info", '{"id":"2"}')]
    assert [r.value for r in ods.malformed(df, ods.ARRAY_ENVELOPE).collect()] == ['{"table":"sku_info","ty']
    with pytest.raises(Exception, match="(?i)malformed"):
        ods.parse_array(df, strict=True).collect()


def test_object_envelope(spark):
    df = messages(
        spark,
        '{"table":"User_Info","type":"bootstrap-insert","data":{"id":1}}',
        '{"table":"order_info","type":"bootstrap-insert","data":{"id":2}}',
        '{"table":"order_info","type":"insert","data":{"id":3}}',
        '{"table":"order_info","type":"delete","data":{"id":4}}',
        '{"table":"order_info","type":"insert","data":null}',
    )
    got = sorted((r.topic, r.value) for r in ods.route(ods.parse_object(df), ods.OBJECT_OPS).collect())
    assert got == [("ods_order_info", '{"id":3}'), ("ods_user_info", '{"id":1}')]
    assert ods.malformed(df, ods.OBJECT_ENVELOPE).count() == 1


def test_unquoted_numbers_stay_exact(spark):
    row = '{"id":9007199254740993,"price":99999999999999.99,"rate":0.12345678901234567890,"text":"a\\"b","none":null}'
    for parse, data in ((ods.parse_array, f"[{row}]"), (ods.parse_object, row)):
        value = parse(messages(spark, f'{{"table":"sku_info","type":"insert","data":{data}}}')).first()["value"]
        for number in ("9007199254740993", "99999999999999.99", "0.1234567890123456789", '"a\\"b"', "null"):
            assert number in value
        typed = parse_lenient(messages(spark, value.replace('"price"', '"order_price"')), ORDER_DETAIL).first()
        assert (typed.id, str(typed.order_price)) == (9007199254740993, "99999999999999.99")


def test_odd_envelopes(spark):
    odd = ['{"table":"sku_info","type":"insert","data":{"id":1}}', "[]", "", None, "5", '{"table":null,"type":"insert","data":[{}]}', '{"table":"a","table":"b","type":"x","data":[]}', '{"table":"a","type":"x","data":[{"a":1234567890123456.25}']
    assert ods.parse_array(messages(spark, *odd, '{"table":"sku_info","type":"insert","data":[null,"x",5,[1],{"a":{"b":[1.50]}}]}')).select("value").collect() == [
        (None,), ("x",), ("5",), ("[1]",), ('{"a":{"b":[1.5]}}',)]
    assert ods.malformed(messages(spark, *odd), ods.ARRAY_ENVELOPE).count() == len(odd) - 2
    assert [tuple(r) for r in ods.parse_object(messages(spark, *odd, '{"table":"SKU_INFO","type":"Insert","data":"text"}')).collect()] == [
        ("sku_info", "insert", '{"id":1}'), ("b", "x", "[]"), ("sku_info", "insert", "text")]


def test_an_envelope_is_parsed_once(spark):
    with held(ods.read_envelopes(messages(spark, "{}").where("value <> ''"), ods.ARRAY_ENVELOPE)) as read:
        for part in (read.where("NOT readable"), ods.rows_of(read, ods.ARRAY_ENVELOPE)):
            part.collect()
            plan = part._jdf.queryExecution().optimizedPlan().toString()
            assert "from_json" not in plan.split("InMemoryRelation")[0]
    once = ods.route(ods.parse_array(messages(spark, "{}")), ods.ARRAY_OPS)._jdf.queryExecution().optimizedPlan().toString()
    assert once.count("from_json(") == 1


def test_numbers_may_be_quoted(spark):
    df = messages(spark, '{"id":"12","province_id":3,"user_id":"x","final_total_amount":"10.05","original_total_amount":7.1,'
                         '"create_time":"2020-12-11 09:37:00","unknown":1}')
    row = order_times(parse_lenient(df, ORDER_INFO)).first()
    assert (row.id, row.province_id, row.user_id) == (12, 3, None)
    assert (str(row.final_total_amount), str(row.original_total_amount)) == ("10.05", "7.10")
    assert (row.create_date, row.create_hour, row.operate_time, row.is_first_order) == ("2020-12-11", "09", "1970-01-01 00:00:00", False)


def test_json_round_trip(spark):
    df = with_no_sku(spark.createDataFrame([(2**60, 1, 3)], "id bigint, order_id bigint, sku_num bigint"))
    back = parse_strict(to_value(df, "t"), ORDER_DETAIL).first()
    assert (back.id, back.order_id, back.sku_num, back.tm_id, back.sku_name) == (2**60, 1, 3, 0, None)


def test_age_and_gender(spark):
    born = ["2001-01-06", "2000-01-02", "1990-01-09", "1989-01-08"]
    users = spark.createDataFrame([(str(i), "1", b, g) for i, (b, g) in enumerate(zip(born, ["F", "M", None, "x"]))],
                                  "id string, user_level string, birthday string, gender string")
    rows = {r.id: (r.age_group, r.gender_name) for r in dim.derive_user(users, date(2021, 1, 1)).collect()}
    ages = [(date(2021, 1, 1) - date.fromisoformat(b)).days // 365 for b in born]
    labels = ["20岁及以下" if a <= 20 else "21岁到 30 岁" if a <= 30 else "30岁及以上" for a in ages]
    assert rows == {str(i): (labels[i], "女" if i == 0 else "男") for i in range(4)}
    assert len(set(labels)) == 3


def test_sku_needs_all_lookups(spark):
    sku = spark.createDataFrame([("1", "10", "5", "a", "20", "30", "t"), ("2", "11", "5", "b", "20", "30", "t")],
                                "id string, spu_id string, price string, sku_name string, tm_id string, category3_id string, create_time string")
    spu = spark.createDataFrame([("10", "spu")], "id string, spu_name string")
    c3 = spark.createDataFrame([("30", "c", "0")], "id string, name string, category2_id string")
    tm = dim.trademark_rows(spark.createDataFrame([("20", "brand")], "tm_id string, tm_name string"))
    rows = dim.enrich_sku(sku, spu, c3, tm).collect()
    assert [(r.id, r.spu_name, r.category3_name, r.tm_name) for r in rows] == [("1", "spu", "c", "brand")]
    details = spark.createDataFrame([(1, 9, 1, 2, "own"), (2, 9, 2, 1, "own")], "id bigint, order_id bigint, sku_id bigint, sku_num bigint, sku_name string")
    got = dwd.enrich_detail(details, dim.enrich_sku(sku, spu, c3, tm)).collect()
    assert [(r.id, r.sku_name, r.spu_id, r.tm_id, r.category3_id) for r in got] == [(1, "own", 10, 20, 30)]


ORDERS = [(1, 7, "2020-01-02 00:00:00", 1), (2, 7, "2020-01-01 00:00:00", 1), (3, 8, "2020-01-01 00:00:00", 2), (4, 9, "2020-01-01 00:00:00", 1)]


def order_frame(spark, rows=ORDERS):
    return spark.createDataFrame(rows, "id bigint, user_id bigint, create_time string, province_id bigint")


def test_first_order_per_user(spark):
    status = spark.createDataFrame([("9", False)], "user_id string, is_first_order boolean")
    flags = {r.id: r.is_first_order for r in dwd.flag_first_order(order_frame(spark), status).collect()}
    assert flags == {1: False, 2: True, 3: True, 4: False}


def test_dropped_order_does_not_make_its_user_known(spark):
    provinces = spark.createDataFrame([("1", "p", "a", "i")], "id string, name string, area_code string, iso_code string")
    users = spark.createDataFrame([(u, "1", "1990-01-01", "F") for u in ("7", "8")], "id string, user_level string, birthday string, gender string")
    enriched = dwd.enrich_order(order_frame(spark), provinces, users, None, date(2021, 1, 1))
    assert {r.id: (r.is_first_order, r.province_name, r.user_gender) for r in enriched.collect()} == {1: (False, "p", "女"), 2: (True, "p", "女")}
    assert [tuple(r) for r in dwd.user_status_rows(enriched).collect()] == [("7", True)]


def test_wide_row_columns(spark):
    order = with_no_dimensions(spark.createDataFrame([(5, 7, "2020-01-01 10:00:00", "2021-09-09 00:00:00")], "id bigint, user_id bigint, create_time string, operate_time string"))
    detail = with_no_sku(spark.createDataFrame([(50, 5, 3, "other time")], "id bigint, order_id bigint, sku_num bigint, create_time string"))
    row = dws.wide_join(order, detail).first()
    assert (row.order_id, row.order_detail_id, row.create_time, row.operate_time) == (5, 50, "2020-01-01 10:00:00", "1970-01-01 00:00:00")


def test_first_start(spark):
    def log(mid, ts):
        return f'{{"common":{{"mid":"{mid}","uid":"1"}},"ts":{ts}}}'
    day = 1_600_041_600_000
    df = messages(spark, log("a", day + 5), log("a", day + 1), log("b", day + 2), log("a", day + 86_400_000))
    got = sorted((r.log_date, r.mid, r.ts - day) for r in dau.first_start(dau.parse_startup(df)).collect())
    assert got == [("2020-09-14", "a", 1), ("2020-09-14", "b", 2), ("2020-09-15", "a", 86_400_000)]
    row = dau.parse_startup(messages(spark, log("a", day - 1)), "Asia/Shanghai").first()
    assert (row.log_date, row.log_hour) == ("2020-09-14", "07")


def test_zone_of_the_session_does_not_matter(spark):
    df = messages(spark, '{"common":{"mid":"a"},"ts":1600041599999}')
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        row = dau.parse_startup(df).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert (row.log_date, row.log_hour) == ("2020-09-13", "23")


def test_window_join_needs_a_shared_window(spark):
    order = with_no_dimensions(spark.createDataFrame([(1,)], "id bigint")).withColumn("timestamp", F.timestamp_seconds(F.lit(1004)))
    times = [1000, 1015, 1019, 1020, 985, 984]
    detail = with_no_sku(spark.createDataFrame([(i, 1) for i in times], "id bigint, order_id bigint")).withColumn("timestamp", F.timestamp_seconds("id"))
    got = sorted(r.order_detail_id for r in dws.wide_join_windowed(order, detail).collect())
    assert got == [985, 1000, 1015, 1019]


def test_plans_prune_and_combine(spark):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()
    shop_orders = order_frame(spark)
    newest = plan(dim.latest(shop_orders, ["user_id"], ["create_time"]))
    assert newest.count("WindowGroupLimit") == 2
    flags = plan(dwd.flag_first_order(shop_orders))
    assert "Window" not in flags and "partial_min" in flags


def test_first_orders_need_no_sorting(spark):
    orders = spark.createDataFrame([(-5, 1, "2021-01-01 10:00:00"), (9, 1, "2021-01-01 09:59:59"), (2**62, 2, "2021-01-01 00:00:00"),
                                    (3, 2, None), (7, 3, "2021-01-01 00:00:00"), (-(2**62), 3, "2021-01-01 00:00:00")], "id long, user_id long, create_time string")
    firsts = dwd.first_orders(orders)
    assert {r.user_id: r.first_order_id for r in firsts.collect()} == {1: 9, 2: 3, 3: -(2**62)}
    assert "SortAggregate" not in firsts._jdf.queryExecution().executedPlan().toString()


def test_names_and_ddl():
    assert ddl(SKU_INFO[:2]) == "`id` string, `spu_id` string"
    assert len(names(ORDER_INFO)) == 19
