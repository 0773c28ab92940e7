"""Selections over small tables: operators, order, nulls, algebra, aggregates, vectors, graphs."""

import math
import statistics

import pytest

from orrery import Engine
from orrery.errors import DiagnosticError
from orrery.plans.nodes import Filter, IndexLookup, Limit, Offset, Projection, Reverse
from orrery.plans.rewrite import rewrite


def table(spark, schema, rows, name="things"):
    e = Engine(spark)
    e.create_dataset(name, "table", schema)
    if rows:
        e.insert(name, rows)
    return e.select(name)


def code(call):
    with pytest.raises(DiagnosticError) as e:
        call()
    return e.value.code


def ids(s):
    return [r["id"] for r in s.consume()]


@pytest.fixture(scope="module")
def boats(spark):
    return table(spark, {"id": "int", "hull": "str(9)"}, [{"id": i, "hull": h} for i, h in ((7, "oak"), (4, "elm"), (9, "oak"), (4, "elm"), (5, "ash"))], "boats")


CATCHES = [("north", 2.5, "k1"), ("south", None, "k2"), (None, 6.0, "k3"), ("south", 9.5, "k4"), ("east", 1.0, "k5"), ("north", 0.5, "k6")]


@pytest.fixture(scope="module")
def catches(spark):
    return table(spark, {"port": "nullable(text)", "tons": "nullable(float)", "crew": "str(4)"}, [dict(zip(("port", "tons", "crew"), r)) for r in CATCHES], "catches")


def test_dedupe_and_order(boats):
    assert ids(boats) == [7, 4, 9, 4, 5] and len(boats) == 5 and boats[0] == {"id": 7, "hull": "oak"}
    assert ids(boats.sort("id").unique()) == ids(boats.unique().sort("id")) == [4, 5, 7, 9]
    assert [r["hull"] for r in boats.distinct("hull").reverse()] == ["ash", "elm", "oak"] and ids(boats.distinct("hull")) == [7, 4, 5]
    assert ids(boats.order("id").order(("hull", "desc"))) == [7, 9, 4, 4, 5] and ids(boats.order(("hull", "asc"), ("id", "desc"))) == [5, 4, 4, 9, 7]
    assert ids(boats.order("hull").reverse().offset(1).limit(2)) == [7, 4] and ids(boats.limit(3).unique("id").sort("id").reverse().limit(2)) == [9, 7]
    assert boats.offset(4) == [{"id": 5, "hull": "ash"}] and ids(boats.offset(9)) == [] and ids(boats.offset(1).reverse().offset(1)) == [4, 9, 4]


def test_flatten_expand(spark):
    routes = [{"no": 3, "stops": ["quay", "pier", "lock"], "meta": {"line": "blue", "night": False}}, {"no": 8, "stops": [], "meta": {"line": "grey", "night": True}}, {"no": 6, "stops": ["lock"], "meta": {"line": "grey", "night": True}}]
    s = table(spark, {"no": "int", "stops": "list(str(12))", "meta": "json"}, routes, "routes")
    assert [(r["no"], r["stops"]) for r in s.flatten("stops")] == [(3, "quay"), (3, "pier"), (3, "lock"), (6, "lock")]
    assert s.expand("meta").flatten("stops").where({"field": "stops", "op": "=", "value": "lock"}).consume() == [{"no": 3, "stops": "lock", "line": "blue", "night": False}, {"no": 6, "stops": "lock", "line": "grey", "night": True}]
    assert s.consume()[1]["meta"] == routes[1]["meta"]
    assert code(lambda: s.flatten("no").consume()) == "type_mismatch" and code(lambda: s.expand("stops").consume()) == "type_mismatch"
    clash = table(spark, {"line": "text", "meta": "json"}, [{"line": "x", "meta": {"line": "y"}}])
    assert code(lambda: clash.expand("meta").consume()) == "schema_mismatch"


def test_expand_map_takes_all_keys_or_none(spark):
    e = Engine(spark)
    e.register("few", spark.range(1000).selectExpr("id", "map(concat('k', cast(id as string)), id) as kv"))
    e.register("many", spark.range(1001).selectExpr("id", "map(concat('k', cast(id as string)), id) as kv"))
    assert len(e.select("few").expand("kv").to_df().columns) == 1001
    assert code(lambda: e.select("many").expand("kv").to_df()) == "schema_mismatch"


def test_algebra(spark):
    left, right = (table(spark, {"id": "int"}, [{"id": i} for i in v]) for v in ((4, 6, 6, 9), (6, 9, 9, 2)))
    assert ids(left + right) == [4, 6, 9, 2] and ids(left & right) == [6, 9] and ids(left - right) == [4] and ids(left ^ right) == [4, 2]
    assert ids(right - left) == [2] and sorted(r["id"] for r in (left + right).to_df().collect()) == [2, 4, 6, 9]
    product = (left * right).consume()
    assert len(product) == 16 and product[5] == {"left": {"id": 6}, "right": {"id": 9}}
    other = table(spark, {"x": "int"}, [{"x": 1}])
    assert code(lambda: (left + other).consume()) == "schema_mismatch"


def test_aggregates(spark, catches):
    tons = [t for _, t, _ in CATCHES if t is not None]
    want = {"sum": sum(tons), "avg": statistics.fmean(tons), "min": min(tons), "max": max(tons), "median": statistics.median(tons), "std": statistics.pstdev(tons)}
    assert catches.count().consume() == len(CATCHES)
    for op, v in want.items():
        assert catches.aggregate(op, "tons").consume() == pytest.approx(v)
    assert [(g["port"], g["count"]) for g in catches.group("port").count().consume()] == [("north", 2), ("south", 2), (None, 1), ("east", 1)]
    assert [(g["port"], g["sum"]) for g in catches.reverse().group("port").sum("tons").consume()] == [("north", 3.0), ("east", 1.0), ("south", 9.5), (None, 6.0)]
    assert [g["port"] for g in catches.order(("crew", "desc")).group("port").count().consume()] == ["north", "east", "south", None]
    assert [(g["port"], [r["crew"] for r in g["records"]]) for g in catches.group("port").consume()] == [("north", ["k1", "k6"]), ("south", ["k2", "k4"]), (None, ["k3"]), ("east", ["k5"])]
    assert [[r["crew"] for r in g["records"]] for g in catches.order(("tons", "desc")).group("port").consume()] == [["k4", "k2"], ["k3"], ["k1", "k6"], ["k5"]]
    assert code(lambda: catches.sum("crew").consume()) == "invalid_aggregation" and code(lambda: catches.sum("nope").consume()) == "unknown_field"
    none = catches.where({"field": "tons", "op": ">", "value": 40})
    assert none.count().consume() == 0 and none.sum("tons").consume() == 0 and none.avg("tons").consume() is None and none.group("port").count().consume() == []
    one = table(spark, {"count": "int"}, [{"count": 1}])
    assert code(lambda: one.group("count").count().consume()) == "schema_mismatch"


def test_predicates(spark):
    s = table(spark, {"id": "int", "n": "nullable(int)", "f": "nullable(float)", "t": "nullable(str(10))", "tags": "list(text)", "m": "map(str(5), int)", "e": 'enum("a", "b")'},
              [{"id": 1, "n": 5, "f": 5.0, "t": "abc", "tags": ["x"], "m": {"k": 1}, "e": "a"}, {"id": 2, "n": None, "f": None, "t": None, "tags": [], "m": {}, "e": "b"}, {"id": 3, "n": 7, "f": math.nan, "t": "b[c", "tags": ["y", "x"], "m": {"z": 2}, "e": "a"}])
    at = lambda f, op, v: ids(s.where({"field": f, "op": op, "value": v}))
    no = lambda f, op, v: ids(s.where({"not": {"field": f, "op": op, "value": v}}))
    assert at("n", "=", None) == [2] and at("n", "!=", None) == [1, 3] and at("n", "!=", 5) == [2, 3] and at("n", ">", None) == []
    assert at("n", ">=", 5) == [1, 3] and no("n", ">", 5) == [1, 2] and no("n", "=", 5) == [2, 3]
    assert at("f", ">", 1) == [1] and no("f", ">", 1) == [2, 3] and at("f", "<", 9) == [1]
    assert at("n", "in", [5, None]) == [1, 2] and no("n", "in", [5, None]) == [3] and no("n", "in", [5]) == [2, 3] and at("n", "in", []) == []
    assert at("t", "contains", "b") == [1, 3] and at("t", "startsWith", "a") == [1] and at("t", "endsWith", "c") == [1, 3] and at("t", "matches", "^.b") == [1]
    for op in ("startsWith", "endsWith", "matches"):
        assert at("t", op, "zz") == [] and no("t", op, "a") == [i for i in (1, 2, 3) if i not in at("t", op, "a")]
        assert code(lambda op=op: s.where({"field": "t", "op": op, "value": "a", "strict": True}).consume()) == "type_mismatch"
        assert ids(s.where({"field": "id", "op": "!=", "value": 2}).where({"field": "t", "op": op, "value": "a", "strict": True})) == [i for i in at("t", op, "a") if i != 2]
    assert at("tags", "contains", "x") == [1, 3] and at("m", "contains", "k") == [1] and at("e", "=", "a") == [1, 3] and no("tags", "contains", "x") == [2]
    for bad, want in ((("n", "=", "x"), "invalid_operand"), (("n", "~", 1), "unknown_operator"), (("t", "matches", "("), "invalid_pattern"), (("zz", "=", 1), "unknown_field"), (("tags", ">", 1), "invalid_operand"), (("n", "in", 3), "invalid_operand"), (("e", "=", "zz"), "invalid_operand")):
        assert code(lambda b=bad: at(*b)) == want



def test_filters_reach_the_scan(spark):
    s = Engine(spark).register("orders", spark.read.parquet("/root/testdata/sf0.001/orders.parquet"))
    plan = s.where({"and": [{"field": "o_totalprice", "op": ">", "value": 1000}, {"not": {"field": "o_orderstatus", "op": "=", "value": "F"}}]}).project("o_orderkey").to_df()._jdf.queryExecution().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double" in plan


def test_vectors(spark):
    e = Engine(spark)
    e.create_dataset("winds", "vector", {"id": {"type": "int", "constraints": ["pk"]}, "dir": {"type": "list(float)", "constraints": [{"vector": 2}, "nullable"]}})
    e.insert("winds", [{"id": 11, "dir": [2, 0]}, {"id": 12, "dir": [0, 3]}, {"id": 13, "dir": [3, 4]}, {"id": 14}])
    s = e.select("winds")
    near = s.similarity("dir", [5, 0]).consume()
    assert [r["id"] for r in near] == [11, 13, 12] and [r["_distance"] for r in near] == pytest.approx([0, 0.4, 1]) and near[1]["_similarity"] == pytest.approx(0.6)
    far = s.distance("dir", [0, 0]).limit(2).consume()
    assert [(r["id"], r["_distance"]) for r in far] == [(11, 2.0), (12, 3.0)] and far[0]["_similarity"] == pytest.approx(1 / 3)
    assert code(lambda: s.similarity("dir", [0, 0])) == "invalid_vector" and code(lambda: s.similarity("dir", [1.0]).consume()) == "invalid_vector"
    assert code(lambda: s.similarity("dir", [1, 2], metric="x")) == "invalid_metric" and code(lambda: e.insert("winds", {"id": 19, "dir": [1.0]})) == "vector_dimension"
    e.insert("winds", {"id": 15, "dir": [0, 0]})
    assert code(lambda: e.select("winds").similarity("dir", [1, 0]).consume()) == "invalid_vector"


def test_graph(spark):
    e = Engine(spark)
    e.create_dataset("canals")
    e.insert("canals", [{"id": i, "open": o} for i, o in (("a", True), ("b", False), ("c", True), ("d", True), ("e", False))])
    one = lambda i: e.select("canals").where({"field": "id", "op": "=", "value": i})
    link = e.add_link(one("a"), one("b"), label="flows", data={"width": 12})
    assert link["link"]["id"] == 1 and not link["link"]["bidir"]
    e.add_link(one("a"), one("c"), label="flows", data={"width": 30})
    e.add_link(one("c"), one("d"), label="flows", bidir=True)
    e.add_link(one("d"), one("b"), label="flows")
    e.add_link(one("b"), one("e"), label="road")
    assert ids(one("a").traverse("flows")) == ["b", "c"] and ids(one("a").traverse("flows", depth=9)) == ["b", "c", "d"] and ids(one("d").traverse("flows")) == ["c", "b"] and ids(one("c").traverse("flows")) == ["d"]
    assert ids(one("a").traverse("flows", depth=2, predicate={"field": "width", "op": ">=", "value": 20})) == ["c"]
    assert ids(one("c").traverse("flows", predicate={"field": "width", "op": "=", "value": None})) == ["d"]
    assert ids(one("a").traverse("flows", depth=2).where({"field": "open", "op": "=", "value": True})) == ["c", "d"]
    assert ids(one("e").traverse("flows")) == [] and ids(e.select("canals").where({"field": "id", "op": "in", "value": ["a", "b"]}).traverse("road")) == ["e"]
    assert ids(e.select("canals").where({"field": "id", "op": "in", "value": ["a", "d"]}).reverse().traverse("flows")) == ["c", "b"]
    assert code(lambda: one("a").traverse("flows", predicate={"field": "zz", "op": "=", "value": 1}).consume()) == "unknown_field"
    assert code(lambda: e.add_link(e.select("canals"), one("a"), label="x")) == "invalid_link" and code(lambda: one("a").traverse("flows", depth=0)) == "invalid_traversal"
    assert sorted(r["id"] for r in one("a").traverse("flows", depth=5).to_df().collect()) == ["b", "c", "d"]
    e.insert("canals", {"id": "e", "weir": "W"})
    assert one("e").consume() == [{"id": "e", "weir": "W"}] and code(lambda: e.select("canals").where({"field": "open", "op": "=", "value": True}).consume()) == "missing_field"
    assert code(lambda: e.delete("canals")) == "unsupported" and ids(e.select("canals")) == list("abcde")


def test_rewrite_rules(boats):
    s = boats.project("id", "hull").where({"field": "id", "op": "=", "value": 4}).project("id").offset(0).offset(1).offset(1).limit(10).limit(2).reverse().reverse()
    nodes, rules = rewrite(s.nodes, frozenset({"id"}))
    assert isinstance(nodes[0], IndexLookup) and [type(n) for n in nodes[1:]] == [Projection, Offset, Limit]
    assert set(rules) >= {"predicate_pushdown", "merge_projections", "remove_zero_offset", "merge_offsets", "merge_limits", "remove_double_reverse", "index_selection"}
    assert s.consume() == s.consume(optimize=False)
    unsafe = (Projection((*boats.project("id").nodes[0].tree,)), Offset(1), Filter({"field": "id", "op": "=", "value": 2}), Reverse(), Limit(1))
    assert rewrite(unsafe) == (unsafe, [])
    assert "join_elimination" in boats.product(boats.limit(0)).explain()["rules"] and boats.product(boats.limit(0)).consume() == []
    assert boats.where({"field": "id", "op": "=", "value": 4}).explain()["logical"][0]["node"] == "FilterPlan"


def test_explain_reads_nothing(spark):
    from dataclasses import replace

    e = Engine(spark)
    e.create_dataset("t", "table", {"id": "int"})

    def fail():
        raise AssertionError("read")

    s = e.select("t")
    s = replace(s, source=replace(s.source, frame=fail))
    s.where({"field": "id", "op": "=", "value": 1}).sort("id").limit(2).explain()


def test_descending_orders_and_firsts(spark):
    rows = [{"id": i, "t": t, "n": n, "d": d} for i, (t, n, d) in enumerate([("a", 1.5, True), ("ab", None, False), ("b", 2.5, True), (None, -1.0, False), ("ab", 0.0, True), ("é", 9.0, False)])]
    s = table(spark, {"id": "int", "t": "nullable(text)", "n": "nullable(float)", "d": "bool"}, rows)
    for f in ("t", "n", "d"):
        down = s.order((f, "desc"))
        order = ids(down)
        assert ids(down.unique("d")) == [i for k, i in enumerate(order) if rows[i]["d"] not in [rows[j]["d"] for j in order[:k]]]
        assert [g["d"] for g in down.group("d").count().consume()] == list(dict.fromkeys(rows[i]["d"] for i in order))
        assert ids(down.unique()) == order and ids(down.reverse()) == order[::-1]
    assert ids(s.order(("t", "desc"))) == [5, 2, 1, 4, 0, 3]


def truth(p, r):
    """Two-valued evaluation of a predicate over one record."""
    if "and" in p:
        return all(truth(q, r) for q in p["and"])
    if "or" in p:
        return any(truth(q, r) for q in p["or"])
    if "not" in p:
        return not truth(p["not"], r)
    a, op, b = r[p["field"]], p["op"], p["value"]
    if op in ("=", "!="):
        return (a == b) == (op == "=")
    if op == "in":
        return a in b
    if a is None or b is None:
        return False
    return {">": lambda: a > b, ">=": lambda: a >= b, "<": lambda: a < b, "<=": lambda: a <= b, "contains": lambda: b in a, "startsWith": lambda: a.startswith(b), "endsWith": lambda: a.endswith(b)}[op]()


def test_random_predicates(spark):
    import random

    rng = random.Random(8)
    values = {"n": [None, 0, 1, 2, 5], "f": [None, -1.0, 0.5, 2.0, math.nan], "t": [None, "", "a", "ab", "b"]}
    rows = [{"id": i, **{k: rng.choice(v) for k, v in values.items()}} for i in range(80)]
    s = table(spark, {"id": "int", "n": "nullable(int)", "f": "nullable(float)", "t": "nullable(text)"}, rows)

    def tree(depth):
        kind = rng.choice(["and", "or", "not", "leaf"]) if depth else "leaf"
        if kind in ("and", "or"):
            return {kind: [tree(depth - 1) for _ in range(rng.randint(1, 3))]}
        if kind == "not":
            return {"not": tree(depth - 1)}
        f = rng.choice("nft")
        op = rng.choice(["=", "!=", ">", ">=", "<", "<=", "in"] + (["contains", "startsWith", "endsWith"] if f == "t" else []))
        usual = [v for v in values[f] if v is None or v == v]
        if op == "in":
            return {"field": f, "op": op, "value": rng.sample(usual, rng.randint(0, 3))}
        return {"field": f, "op": op, "value": rng.choice([v for v in usual if v is not None or op not in ("contains", "startsWith", "endsWith")])}

    for _ in range(40):
        p = tree(3)
        assert ids(s.where(p)) == [r["id"] for r in rows if truth(p, r)], p
