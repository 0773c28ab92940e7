"""Order of files, plans of ordered selections, descending keys, stored graphs, references of tables, upserts."""

import datetime as dt
import math
from decimal import Decimal

import pytest

from orrery import Engine, Session
from orrery.errors import DiagnosticError

ORDERS = "/root/testdata/sf0.001/orders.parquet"


def code(call):
    with pytest.raises(DiagnosticError) as e:
        call()
    return e.value.code


def plan(df):
    return df._jdf.queryExecution().toString()


def test_order_is_that_of_the_files(spark, tmp_path):
    path = f"{tmp_path}/t"
    for i, (a, z) in enumerate(((0, 3), (3, 60_000), (60_000, 60_002))):
        spark.range(a, z).coalesce(1).write.parquet(f"{tmp_path}/part{i}")
    (tmp_path / "t").mkdir()
    for i in range(3):
        next((tmp_path / f"part{i}").glob("*.parquet")).rename(f"{path}/part-0000{i}.parquet")
    e = Engine(spark)
    s = e.register("t", spark.read.parquet(path).where("id <> 4").select("id"))
    assert [r["id"] for r in s.limit(6)] == [0, 1, 2, 3, 5, 6] and [r["id"] for r in s.reverse().limit(3)] == [60_001, 60_000, 59_999]
    e.insert("t", [{"id": 4}, {"id": -1}])
    assert [r["id"] for r in e.select("t").reverse().limit(3)] == [-1, 4, 60_001]
    e.delete("t", {"field": "id", "op": ">", "value": 10})
    assert [r["id"] for r in e.select("t")] == [0, 1, 2, 3, 5, 6, 7, 8, 9, 10, 4, -1]


def test_filters_reach_the_scan_of_ordered_plans(spark):
    s = Engine(spark).register("orders", spark.read.parquet(ORDERS))
    dear = s.where({"field": "o_totalprice", "op": ">", "value": 1000}).project("o_orderkey")
    for df in (dear.to_df(ordered=True), dear.sort("o_orderkey").limit(3).to_df(), dear.unique("o_orderkey").to_df(), dear.limit(5).to_df()):
        assert "GreaterThan(o_totalprice,1000.0)" in plan(df) and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double" in plan(df)


def test_pages_are_one_node(spark):
    s = Engine(spark).register("orders", spark.read.parquet(ORDERS)).sort("o_orderkey")
    page = s.offset(40).limit(5).to_df()
    assert "TakeOrderedAndProject" in plan(page) and "SinglePartition" not in plan(page).split("Physical Plan")[1]
    every = [r["o_orderkey"] for r in s.project("o_orderkey").to_df(ordered=True).collect()]
    assert [r["o_orderkey"] for r in page.collect()] == every[40:45]
    for n in (1, 700, len(every) - 1, len(every), 9999):
        rest = s.project("o_orderkey").offset(n)
        assert [r["o_orderkey"] for r in rest] == every[n:] and "SinglePartition" not in plan(rest.to_df()).split("Physical Plan")[1]


def test_descending_keys_of_all_types(spark):
    rows = [
        (1, math.nan, Decimal(10) ** 23, -(1 << 63), "b", [1.5, math.nan], dt.date(2024, 1, 2)), (2, 4.0, -Decimal(10) ** 23, (1 << 63) - 1, "", [1.5], dt.date(1066, 1, 1)), (3, None, None, None, None, None, None),
        (4, -math.inf, Decimal(0), 0, "ba", [], dt.date(9999, 1, 1)), (5, math.nan, Decimal(1), -1, "\U0001f600", [None, 2.0], dt.date(1970, 1, 1)), (6, 0.0, Decimal(-1), 1, "\uffee", [1.5, 0.0], dt.date(1969, 12, 31)),
    ]
    df = spark.createDataFrame([(*r, i % 2) for i, r in enumerate(rows)], "id long, f double, d decimal(38,0), n long, t string, a array<double>, day date, half int")
    s = Engine(spark).register("t", df)
    for name in ("f", "d", "n", "t", "a", "day"):
        want = [r["id"] for r in df.orderBy(df[name].desc_nulls_last(), "id").collect()]
        down = s.sort("id").order((name, "desc"))
        assert [r["id"] for r in down.unique("id")] == [r["id"] for r in down] == want, name
        half = {r[0]: r[-1] for r in [(*r, i % 2) for i, r in enumerate(rows)]}
        assert [r["id"] for r in down.unique("half")] == [next(i for i in want if half[i] == h) for h in dict.fromkeys(half[i] for i in want)]
        assert [[r["id"] for r in g["records"]] for g in down.group("half")] == [[i for i in want if half[i] == h] for h in dict.fromkeys(half[i] for i in want)]


def test_graphs_through_a_restart(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    e = Engine(spark, path)
    e.register("g", spark.range(6).selectExpr("id", "concat('n', id) as name"), kind="graph")
    e.register_links("g", spark.range(5).selectExpr("'to' as label", "id as source", "id + 1 as target", "date_add(date'2024-01-01', cast(id as int)) as day", "cast(id as decimal(9,2)) as cost"))
    one = lambda e, i: e.select("g").where({"field": "id", "op": "=", "value": i})
    e.add_link(one(e, 0), one(e, 5), label="to", data={"day": dt.date(2025, 5, 5)})
    e.add_link(one(e, 0), one(e, 4), label="by", data={"when": dt.datetime(2025, 1, 1, 5), "tags": ["x"], "n": 3})
    wanted = {"field": "day", "op": ">=", "value": dt.date(2024, 1, 2)}
    for engine in (e, Engine(spark, path)):
        ids = lambda s: [r["id"] for r in s]
        assert ids(one(engine, 0).traverse("to", depth=2)) == [1, 5, 2] and ids(one(engine, 0).traverse("to", predicate=wanted)) == [5] and ids(one(engine, 1).traverse("to", depth=9, predicate=wanted)) == [2, 3, 4, 5]
        assert ids(one(engine, 0).traverse("by", predicate={"field": "when", "op": "=", "value": dt.datetime(2025, 1, 1, 5)})) == [4] and ids(one(engine, 0).traverse("by", predicate={"field": "n", "op": "<", "value": 3})) == []
    again = Engine(spark, path)
    again.add_link(one(again, 5), one(again, 0), label="to", data={"day": dt.date(2026, 1, 1)})
    assert [r["id"] for r in one(Engine(spark, path), 5).traverse("to")] == [0]


def test_defaults_through_a_restart_and_vacuum(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    s = Session(Engine(spark, path))
    s.execute('create dataset t(table{id(int, pk), d(date, default(cast("2024-02-03", date))), w(duration, default(cast(90, duration))), k(set(int), default([4, 5]))})')
    for i in range(3):
        s.execute(f"add {{id={i}}} into t")
    files = lambda: {x.name for x in (tmp_path / "db" / "data").iterdir()}
    assert len(files()) == 3
    (tmp_path / "db" / "data" / "t-9-torn").mkdir()
    t = Session(Engine(spark, path))
    t.execute("add {id=7} into t")
    t.engine.vacuum()
    assert len(files()) == 1 and len(list((tmp_path / "db").glob("manifest-*.json"))) == 1
    rows = Session(Engine(spark, path)).execute("t()").consume()
    assert [r["id"] for r in rows] == [0, 1, 2, 7] and all(r["d"] == dt.date(2024, 2, 3) and r["w"] == dt.timedelta(seconds=90) and r["k"] == {4, 5} for r in rows)


def test_references_of_tables(spark):
    e = Engine(spark)
    e.register("makers", spark.range(4).selectExpr("id as no", "concat('m', id) as name"), identity=("no",))
    e.register("parts", spark.range(6).selectExpr("id", "nullif(id % 5, 4) as maker"), identity=("id",), references={"maker": "makers"})
    assert Session(e).execute("parts({id>=3}).(id, maker(name))").consume() == [{"id": 3, "maker": {"name": "m3"}}, {"id": 4, "maker": None}, {"id": 5, "maker": {"name": "m0"}}]
    assert code(lambda: e.delete("makers", {"field": "no", "op": "=", "value": 2})) == "reference_in_use"
    e.create_dataset("uses", "table", {"id": {"type": "int", "constraints": ["pk"]}, "maker": {"type": "makers", "constraints": ["nullable"]}})
    raw = lambda n, rows: e.register(n, spark.createDataFrame(rows, "id long, maker long"))
    assert e.insert_selection("uses", raw("a", [(1, 3), (2, None), (3, 0)]))["inserted"] == 3
    assert Session(e).execute("uses().(id, maker(no))").consume() == [{"id": 1, "maker": {"no": 3}}, {"id": 2, "maker": None}, {"id": 3, "maker": {"no": 0}}]
    wrong = raw("b", [(1, 2), (8, 77), (9, 1), (9, 2)])
    assert code(lambda: e.insert_selection("uses", wrong)) in ("missing_reference", "primary_key")
    found = sorted((r["code"], r["row"]["id"]) for r in e.violations("uses", wrong).collect())
    assert found == [("missing_reference", 8), ("primary_key", 1), ("primary_key", 9), ("primary_key", 9)] and e.select("uses").count().consume() == 3
    assert e.violations("uses", raw("c", [(70, 1)])).count() == 0


def test_upserts_keep_plans_short(spark):
    e = Engine(spark)
    e.register("kv", spark.range(100).selectExpr("id as key", "id * 2 as value"), kind="kv")
    for i in range(40):
        e.kv("kv").set(i, -i)
    assert plan(e.select("kv").to_df()).count("Filter") <= 8
    rows = {r["key"]: r["value"] for r in e.select("kv")}
    assert len(rows) == 100 and all(rows[i] == (-i if i < 40 else 2 * i) for i in range(100))
    assert e.kv("kv").delete(50) and e.kv("kv").delete(3) and not e.kv("kv").delete(50) and e.kv("kv").get(50) is None and e.select("kv").count().consume() == 98
    e.kv("kv").set(50, 1)
    assert e.kv("kv").get(50) == 1
    e.register("g", spark.range(5).selectExpr("id", "'x' as name"), kind="graph")
    for _ in range(3):
        e.insert("g", [{"id": 2, "name": "y"}, {"id": 9, "name": "z"}])
    assert {r["id"]: r["name"] for r in e.select("g")} == {0: "x", 1: "x", 2: "y", 3: "x", 4: "x", 9: "z"}


def test_selections_into_graphs_and_pairs(spark, monkeypatch):
    from orrery.sources import catalog

    for flush in (10_000, 5):  # as literals, and by joins
        monkeypatch.setattr(catalog, "FLUSH", flush)
        e = Engine(spark)
        raw = e.register("raw", spark.createDataFrame([(i % 30, f"n{i}", i * 1.5) for i in range(40)], "id long, name string, size double"))
        e.create_dataset("g")
        assert e.insert_selection("g", raw)["inserted"] == 40
        assert e.select("g").consume() == [{"id": i, "name": f"n{i + 30 if i < 10 else i}", "size": (i + 30 if i < 10 else i) * 1.5} for i in range(30)]
        e.register("more", spark.range(20, 50).selectExpr("id", "'m' as name", "0.5D as size"))
        e.insert_selection("g", e.select("more").sort("id").reverse())
        got = e.select("g").consume()
        assert [r["id"] for r in got] == [*range(30), *range(49, 29, -1)] and got[25]["name"] == "m" and got[3]["name"] == "n33"
        e.register("kv", spark.range(10).selectExpr("id as key", "id * 10 as value"), kind="kv")
        e.kv("kv").set(3, -3)
        e.register("pairs", spark.range(2, 12).selectExpr("id as key", "id as value"))
        e.insert_selection("kv", e.select("pairs"))
        assert [(r["key"], r["value"]) for r in e.select("kv")][:3] == [(0, 0), (1, 10), (2, 2)] or flush == 10_000
        assert {r["key"]: r["value"] for r in e.select("kv")} == {0: 0, 1: 10, **{i: i for i in range(2, 12)}}
        e.register("bad", spark.range(30).selectExpr("nullif(id, 7) as id", "'x' as name", "1D as size"))
        assert code(lambda: e.insert_selection("g", e.select("bad"))) == "required"


def test_links_to_nowhere(spark):
    e = Engine(spark)
    e.register("g", spark.range(3).selectExpr("id"), kind="graph")
    e.register_links("g", spark.createDataFrame([("to", 0, 1), ("to", 1, 2), ("to", 2, 7)], "label string, source long, target long"))
    start = e.select("g").where({"field": "id", "op": "=", "value": 0})
    assert [r["id"] for r in start.traverse("to", depth=2)] == [1, 2] == [r["id"] for r in start.traverse("to", depth=2)]
    assert code(lambda: start.traverse("to", depth=3).consume()) == "invalid_traversal"
