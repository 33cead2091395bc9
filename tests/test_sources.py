"""What rules may read, load times by key, and a warehouse behind JDBC."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import releases
from tidewatch.operators.releases import rule
from tidewatch.plans import api
from tidewatch.sources import boundary
from tidewatch.sources.observe import QueryError, Warehouse, key_of, latest_by_relation, observe, resolve_relation

AT = datetime(2024, 1, 30, 16, 4)


@pytest.fixture
def places(spark, tmp_path):
    """A folder of rules with a file in it, and a file outside."""
    inner, outer = tmp_path / "cfg", tmp_path / "outside"
    inner.mkdir()
    data = spark.createDataFrame([(1, "a", AT), (2, "b", datetime(2024, 1, 29))], "v int, k string, at timestamp_ntz")
    data.write.parquet(str(inner / "t"))
    data.write.parquet(str(outer))
    return str(inner), str(outer)


def seen(spark, folder, given=None, **fields):
    base = {"relation": "read_parquet('t')", "loaded_at_field": "at"} | fields
    r = observe(spark, releases.rules_frame(spark, [rule("s", cron="0 6 * * *", **base)]), folder, given).first()
    return r["code"] or r["observed"]


PROBES = [
    "(SELECT * FROM parquet/**/.`{outer}`)",
    "(SELECT * FROM `parquet`.`{outer}`)",
    "parquet.`{outer}`",
    "`parquet` . `{outer}`",
    "(WITH c AS (SELECT * FROM parquet.`{outer}`) SELECT * FROM c)",
    "(SELECT * FROM read_parquet('t') WHERE v IN (SELECT v FROM parquet.`{outer}`))",
    "(SELECT v, (SELECT max(at) FROM PARQUET.`{outer}`) AS at FROM read_parquet('t'))",
    "(SELECT * FROM read_parquet('t') UNION ALL SELECT * FROM parquet.`{outer}`)",
    "(SELECT * FROM read_parquet('{outer}'))",
    "(SELECT * FROM read_parquet('../outside'))",
    "(SELECT * FROM text.`/etc/passwd`)",
    "(SELECT timestamp_ntz'2024-01-01' AS at, java_method('java.lang.System', 'getenv', 'HOME') AS x)",
    "(SELECT timestamp_ntz'2024-01-01' AS at, `reflect`('java.lang.System', 'getenv', 'HOME') AS x)",
    "outside_view",
    "(SELECT * FROM outside_view)",
]


@pytest.mark.parametrize("relation", PROBES)
def test_relations_stay_in_the_folder(spark, places, relation):
    inner, outer = places
    spark.read.parquet(outer).createOrReplaceTempView("outside_view")
    assert seen(spark, inner, relation=relation.format(outer=outer)) == "E502"


@pytest.mark.parametrize("field, condition", [
    ("(SELECT max(at) FROM parquet.`{outer}`)", None), ("(SELECT max(at) FROM outside_view)", None), ("at", "v = (SELECT max(v) FROM parquet.`{outer}`)"),
    ("at", "EXISTS (SELECT 1 FROM outside_view)"), ("at", "v IN (SELECT v FROM inside_view)"), ("CASE WHEN reflect('java.lang.System', 'getenv', 'HOME') <> '' THEN at END", None),
    ("at", "java_method('java.lang.System', 'getenv', 'HOME') <> ''")])
def test_fields_and_filters_read_nothing_else(spark, places, field, condition):
    inner, outer = places
    spark.read.parquet(outer).createOrReplaceTempView("outside_view")
    spark.read.parquet(inner + "/t").createOrReplaceTempView("inside_view")
    assert seen(spark, inner, loaded_at_field=field.format(outer=outer), filter=condition and condition.format(outer=outer)) == "E502"


def test_what_may_be_read(spark, places):
    inner, outer = places
    spark.read.parquet(inner + "/t").createOrReplaceTempView("inside_view")
    assert seen(spark, inner) == AT
    assert seen(spark, inner, relation="inside_view") == AT
    assert seen(spark, inner, relation="(SELECT at FROM read_parquet('t') WHERE k <> 'read_parquet(''x'')')") == AT
    assert seen(spark, inner, relation="(WITH c AS (SELECT * FROM read_parquet('t')) SELECT a.at FROM c a JOIN read_parquet('t') b ON a.v = b.v WHERE a.v IN (SELECT v FROM c))") == AT
    assert seen(spark, inner, relation="(SELECT timestamp_ntz'2024-01-30 16:04:00' AS at FROM range(3))") == AT
    assert seen(spark, inner, relation="mine", given={"mine": spark.read.parquet(outer)}) == AT
    assert seen(spark, "file://" + inner, relation=f"read_parquet('{inner}/t')") in (AT, "E502")
    assert seen(spark, inner, relation="no_such_table") == "E502" and seen(spark, inner, relation="no_such.table") == "E502" and seen(spark, inner, relation="(SELEC 1)") == "E502"
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    spark.read.parquet(outer).write.mode("overwrite").saveAsTable("shop.orders_in")
    try:
        assert seen(spark, inner, relation="shop.orders_in") == AT and seen(spark, inner, relation="(SELECT * FROM shop.orders_in)") == AT
    finally:
        spark.sql("DROP DATABASE shop CASCADE")


@pytest.mark.parametrize("path, folder, is_in", [
    ("/a/b/c", "/a/b", True), ("/a/bc", "/a/b", False), ("file:/a/b/c", "/a/b", True), ("file:///a/b", "/a/b", True), ("/a/b/../c", "/a/b", False),
    ("s3://x/a/b", "s3://x/a", True), ("s3://x/a/b", "s3://y/a", False), ("s3://x/a", "/x", False), ("/x/a", "s3://x", False)])
def test_inside(path, folder, is_in):
    assert boundary.inside(path, folder) is is_in


def test_csv_is_inferred_without_touching_the_session(spark, tmp_path):
    (tmp_path / "t.csv").write_text("v,at\n1,2024-01-30 16:04:00\n")
    before = spark.conf.get("spark.sql.timestampType")
    assert dict(resolve_relation(spark, "read_csv('t.csv')", str(tmp_path)).dtypes) == {"v": "int", "at": "timestamp_ntz"}
    assert spark.conf.get("spark.sql.timestampType") == before
    with pytest.raises(QueryError):
        resolve_relation(spark, "read_csv('/etc/hosts')", str(tmp_path))


def test_keys_are_recognised():
    from pyspark.sql import types as T

    kinds = {"a": T.StringType(), "n": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType()}
    assert key_of("a = 'x y'", kinds) == (("a", "x y"),)
    assert key_of(" n=5 and `a` = '' AND L = -7", kinds) == (("a", ""), ("l", -7), ("n", 5))
    for other in (None, "a = 5", "n = '5'", "d = 1", "a = 'x' OR n = 1", "a = 'it''s'", "a = 'x' AND a = 'y'", "z = 1", "a <> 'x'", "a = n", "NOT a = 'x'", "n = 99999999999999999999"):
        assert key_of(other, kinds) is None


def test_load_times_by_key_equal_those_side_by_side(spark, monkeypatch):
    from tidewatch.sources import observe as module

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "c", None]), rng.randrange(30), datetime(2024, 1, 1, rng.randrange(24), rng.randrange(60)), rng.choice([None, datetime(2023, 5, rng.randrange(1, 28))])) for _ in range(900)]
    df = spark.createDataFrame(rows, "k string, n int, at timestamp_ntz, other timestamp_ntz")
    targets = [(f"n{i}", rng.choice(["at", "other"]), f"n = {i}") for i in range(40)] + [(f"k{k}", "at", f"k = '{k}'") for k in "abcd"]
    targets += [(f"{k}{i}", "at", f"n = {i} AND k = '{k}'") for k in "ab" for i in range(10)] + [("big", "at", "n = 99999999999"), ("all", "other", None), ("some", "at", "n % 7 = 3 OR k = 'a'")]
    got = {r["source_id"]: tuple(r) for r in latest_by_relation(df, targets).collect()}
    monkeypatch.setattr(module, "KEYED", 10_000)
    assert got == {r["source_id"]: tuple(r) for r in latest_by_relation(df, targets).collect()} and len(got) == len(targets)
    monkeypatch.setattr(module, "KEYED", 8)
    keyed = latest_by_relation(df, targets[:40])._jdf.queryExecution().analyzed().toString()
    assert keyed.count("max(") == len({f for _, f, _ in targets[:40]})


def test_failing_sources_are_found_by_halves(spark, monkeypatch):
    from tidewatch.sources import observe as module

    scans = []
    whole = module.latest_by_relation
    monkeypatch.setattr(module, "latest_by_relation", lambda df, targets: scans.append(len(targets)) or whole(df, targets))
    df = spark.range(10).selectExpr("id", "timestamp_ntz'2024-01-01' AS at")
    fine = [rule(f"s{i:02d}", cron="0 6 * * *", relation="r", loaded_at_field="at", filter=f"id > {i}") for i in range(31)]
    bad = rule("s99", cron="0 6 * * *", relation="r", loaded_at_field="CAST(concat('x', id) AS timestamp)")
    got = {r["source_id"]: r["code"] for r in observe(spark, releases.rules_frame(spark, [*fine, bad]), "", {"r": df}).collect()}
    assert got == {f"s{i:02d}": None for i in range(31)} | {"s99": "E502"} and len(scans) == 11


# --- a warehouse behind JDBC: the database that comes with Spark, embedded -------------------------------------------


LOADS = [(i, "ab"[i % 2], datetime(2024, 1, 1 + i % 28, i % 24)) for i in range(300)]


@pytest.fixture(scope="module")
def derby(spark, tmp_path_factory):
    url = f"jdbc:derby:{tmp_path_factory.mktemp('derby')}/db"
    spark.createDataFrame(LOADS, "ID int, K string, LOADED timestamp_ntz").write.option("createTableColumnTypes", "K VARCHAR(9)").jdbc(url + ";create=true", "loads")
    return url


def behind(spark, derby, monkeypatch, *rows):
    monkeypatch.setenv("SHOP_DSN", derby)
    found = observe(spark, releases.rules_frame(spark, [rule(s, cron="0 6 * * *", relation=r, loaded_at_field=f, filter=c) for s, r, f, c in rows]), "", None, {"type": "jdbc", "dsn_env": "SHOP_DSN"})
    return {r["source_id"]: (r["observed"], r["naive"], r["code"]) for r in found.collect()}


def test_rows_are_read_over_jdbc(spark, derby, monkeypatch):
    got = behind(spark, derby, monkeypatch, ("all", "loads", "loaded", None), ("even", "loads", "loaded", "id < 10 AND k = 'a'"), ("sub", "(SELECT * FROM loads WHERE id < 5)", "loaded", None),
                 ("none", "loads", "loaded", "id < 0"), ("number", "loads", "id", None), ("gone", "no_table", "loaded", None), ("field", "loads", "nothing", None))
    assert got["all"] == (max(r[2] for r in LOADS), True, None) and got["even"] == (LOADS[8][2], True, None) and got["sub"] == (LOADS[4][2], True, None)
    assert got["none"] == (None, True, None) and {k: v[2] for k, v in got.items() if v[2]} == {"number": "E503", "gone": "E502", "field": "E502"}


def test_maxima_are_computed_by_the_warehouse(spark, derby):
    df = Warehouse(spark, "jdbc", derby, ()).latest("loads", [("a", "loaded", "k = 'a'"), ("b", "loaded", None)])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "JDBCRelation" in plan and "max((loaded))" in plan and "Aggregate" not in plan and df.count() == 1


@pytest.mark.parametrize("relation, field, condition", [
    ("loads; DROP TABLE loads", "loaded", None), ("(SELECT * FROM loads) x, (SELECT 1 FROM loads)", "loaded", None), ("(SELECT * FROM loads", "loaded", None), ("loads -- x", "loaded", None),
    ("loads", "loaded) FROM loads --", None), ("loads", "loaded", "1 = 1) THEN loaded END), (max(loaded"), ("loads", "loaded", "k = 'open")])
def test_texts_stay_one_query(spark, derby, monkeypatch, relation, field, condition):
    assert behind(spark, derby, monkeypatch, ("s", relation, field, condition))["s"][2] == "E502"
    assert behind(spark, derby, monkeypatch, ("s", "loads", "loaded", None))["s"][2] is None


def test_a_failed_connection_is_not_tried_again(spark, derby, tmp_path, monkeypatch):
    wrong = f"jdbc:derby:{tmp_path}/nowhere"
    got = behind(spark, wrong, monkeypatch, ("a", "loads", "loaded", None), ("b", "other", "loaded", None), ("c", "(SELECT 1)", "loaded", None))
    assert {v[2] for v in got.values()} == {"E501"}
    house = Warehouse(spark, "jdbc", wrong, ("nowhere",))
    first = house.read("loads", [("a", "loaded", None)])
    assert first[0][3] == "E501" and "nowhere" not in first[0][4]
    house.options["url"] = derby  # it would work now, but is not asked
    assert house.read("loads", [("a", "loaded", None)]) == first
    assert behind(spark, "jdbc:nosuch:x", monkeypatch, ("a", "loads", "loaded", None))["a"][2] == "E505"


def test_check_over_jdbc(spark, derby, tmp_path, monkeypatch):
    monkeypatch.setenv("SHOP_DSN", derby)
    source = {"name": "s", "relation": "loads", "loaded_at_field": "loaded", "filter": "k = 'b'", "schedule": {"kind": "cron", "cron": "0 6 * * *"}, "grace": "1h", "observed_timezone": "UTC"}
    (tmp_path / "c.yml").write_text(json.dumps({"version": 1, "connection": {"type": "postgres", "dsn_env": "SHOP_DSN"}, "defaults": {"timezone": "UTC"}, "sources": [source]}))
    row = api.check(spark, str(tmp_path / "c.yml"), datetime(2024, 1, 29, 5)).first()
    assert row["status"] == "ON_TIME" and row["observed_at"] == max(r[2] for r in LOADS if r[1] == "b")


def test_ten_thousand_sources_of_one_relation(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = [rule(f"c{i}", cron="0 6 * * *", relation="orders", loaded_at_field="o_orderdate", filter=f"o_custkey = {i}") for i in range(10_000)]
    got = {r["source_id"]: r["observed"] for r in observe(spark, releases.rules_frame(spark, rows), "", {"orders": orders}).collect()}
    want = {f"c{r[0]}": r[1] for r in orders.groupBy("o_custkey").agg(F.max("o_orderdate")).collect()}
    assert len(got) == 10_000 and {k: v for k, v in got.items() if v} == want
