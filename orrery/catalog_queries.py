"""Queries over the driver's tables, one or more for each operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lang.session import Session
from .operators.selection import Selection
from .sources.catalog import Engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PROPS = {"props": T.StructType([T.StructField("k", T.LongType())])}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def named(name: str, f: Callable, sql: str) -> None:
    QUERIES[name], SQL[name] = f, sql


def data(spark: SparkSession, sf_dir: str, table: str, engine: Engine | None = None, **options) -> Selection:
    """A table of the directory as a dataset."""
    engine = engine or Engine(spark)
    return engine.register(table, spark.read.parquet(f"{sf_dir}/{table}.parquet"), **options)


def session(spark: SparkSession, sf_dir: str, *tables: str) -> Session:
    engine = Engine(spark)
    for t in tables:
        data(spark, sf_dir, t, engine, **(PROPS if t == "events" else {}))
    return Session(engine)


# -- filters and projection -------------------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'")
def filter_project(spark, sf_dir):
    s = data(spark, sf_dir, "lineitem").where({"and": [{"field": "l_quantity", "op": ">=", "value": 45}, {"field": "l_returnflag", "op": "=", "value": "R"}]})
    return s.project("l_orderkey", "l_linenumber", "l_quantity").to_df()


@query("SELECT o_orderkey FROM orders WHERE NOT (o_totalprice > 100000 AND (o_orderstatus = 'F' OR NOT o_orderpriority <> '1-URGENT'))")
def filter_not_or(spark, sf_dir):
    return session(spark, sf_dir, "orders").execute('orders({!(o_totalprice > 100000 && (o_orderstatus = "F" || !(o_orderpriority != "1-URGENT")))}).(o_orderkey)').to_df()


@query("""WITH t AS (SELECT o_orderkey, NULLIF(o_orderstatus, 'O') AS status, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders)
          SELECT o_orderkey FROM t WHERE (status IS NULL OR status <> 'F') AND (price IS NULL OR NOT price > 150000)""")
def filter_nulls(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet")
    made = raw.select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("status"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"))
    s = Engine(spark).register("orders", made)
    return s.where({"and": [{"field": "status", "op": "!=", "value": "F"}, {"not": {"field": "price", "op": ">", "value": 150000}}]}).project("o_orderkey").to_df()


for _name, _test, _where in (
    ("filter_in", {"field": "p_size", "op": "in", "value": [1, 5, 9]}, "p_size IN (1, 5, 9)"),
    ("filter_contains", {"field": "p_type", "op": "contains", "value": "R"}, "contains(p_type, 'R')"),
    ("filter_prefix", {"field": "p_type", "op": "startsWith", "value": "S"}, "starts_with(p_type, 'S')"),
    ("filter_suffix", {"field": "p_type", "op": "endsWith", "value": "L"}, "ends_with(p_type, 'L')"),
    ("filter_regex", {"field": "p_brand", "op": "matches", "value": "#[12]"}, "regexp_matches(p_brand, '#[12]')"),
):
    named(_name, lambda spark, sf_dir, t=_test: data(spark, sf_dir, "part").where(t).project("p_partkey", "p_name").to_df(), f"SELECT p_partkey, p_name FROM part WHERE {_where}")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def filter_date(spark, sf_dir):
    return session(spark, sf_dir, "orders").execute('orders({o_orderdate >= cast("1997-01-01", datetime)}).(o_orderkey, o_orderdate)').to_df()


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'fr' AND n_chars > 2000")
def document_filter(spark, sf_dir):
    return data(spark, sf_dir, "documents", kind="document").where({"and": [{"field": "lang", "op": "=", "value": "fr"}, {"field": "n_chars", "op": ">", "value": 2000}]}).project("doc_id", "n_chars").to_df()


# -- order and reshaping ----------------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk(spark, sf_dir):
    s = data(spark, sf_dir, "orders").order(("o_totalprice", "desc"), ("o_orderkey", "asc")).limit(20)
    return s.project("o_orderkey", "o_totalprice").to_df()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25 OFFSET 100")
def page(spark, sf_dir):
    return data(spark, sf_dir, "orders").sort("o_totalprice", "o_orderkey").offset(100).limit(25).project("o_orderkey", "o_totalprice").to_df()


@query("SELECT o_orderkey FROM orders ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 30 OFFSET 10")
def reverse_page(spark, sf_dir):
    return data(spark, sf_dir, "orders").sort("o_custkey", "o_orderkey").reverse().offset(10).limit(30).project("o_orderkey").to_df()


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50")
def resort_stable(spark, sf_dir):
    s = data(spark, sf_dir, "orders").sort("o_orderkey").order(("o_totalprice", "desc")).order("o_orderpriority").limit(50)
    return s.project("o_orderkey", "o_orderpriority").to_df()


@query("SELECT DISTINCT user_id, event_type FROM events")
def unique_all(spark, sf_dir):
    return data(spark, sf_dir, "events").project("user_id", "event_type").unique().to_df()


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def unique_by(spark, sf_dir):
    return data(spark, sf_dir, "orders").sort("o_orderdate", "o_orderkey").unique("o_custkey").project("o_custkey", "o_orderkey").to_df()


@query("SELECT vec_id, unnest(embedding)::DOUBLE AS embedding FROM embeddings")
def flatten(spark, sf_dir):
    out = data(spark, sf_dir, "embeddings").project("vec_id", "embedding").flatten("embedding").to_df()
    return out.select("vec_id", F.col("embedding").cast("double").alias("embedding"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def expand(spark, sf_dir):
    return data(spark, sf_dir, "events", **PROPS).project("event_id", "props").expand("props").to_df()


@query("SELECT doc_id AS id, (CASE WHEN doc_id % 700 = 0 THEN 1 ELSE 0 END)::BIGINT AS first, n_chars AS size FROM documents")
def expand_map(spark, sf_dir):
    """A map with 700 different keys in all rows; each becomes a field."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = d.select(F.col("doc_id").alias("id"), F.create_map(F.format_string("k%03d", F.col("doc_id") % 700), F.lit(1).cast("long"), F.lit("size"), F.col("n_chars")).alias("kv"))
    out = Engine(spark).register("maps", made).expand("kv").to_df()
    return out.select("id", F.coalesce("k000", F.lit(0).cast("long")).alias("first"), "size")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey OFFSET 14000")
def offset_alone(spark, sf_dir):
    return data(spark, sf_dir, "orders").sort("o_totalprice", "o_orderkey").offset(14000).project("o_orderkey").to_df()


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_partkey % 5 = 0 THEN 'NaN'::DOUBLE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_discount END AS d FROM lineitem)
          SELECT l_suppkey, l_orderkey FROM t QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY d IS NULL, coalesce(isnan(d), FALSE) DESC, d DESC, l_orderkey, l_linenumber) = 1""")
def unique_desc_nan(spark, sf_dir):
    """First rows under a descending order with NaN, which comes first, and null, which comes last."""
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    d = F.when(F.col("l_partkey") % 5 == 0, float("nan")).when(F.col("l_partkey") % 7 != 0, F.col("l_discount"))
    s = Engine(spark).register("lines", raw.select("l_orderkey", "l_linenumber", "l_suppkey", d.alias("d")))
    return s.sort("l_orderkey", "l_linenumber").order(("d", "desc")).unique("l_suppkey").project("l_suppkey", "l_orderkey").to_df()


# -- aggregates and groups --------------------------------------------------------------------------------------------------------------------

_AGG = {"count": ("count(*)", "{}"), "sum": ("sum(o_totalprice)", "round({}, 2)"), "avg": ("avg(o_totalprice)", "round({}, 4)"), "min": ("min(o_totalprice)", "{}"), "max": ("max(o_totalprice)", "{}"), "median": ("median(o_totalprice)", "round({}, 4)"), "std": ("stddev_pop(o_totalprice)", "round({}, 3)")}
_DIGITS = {"sum": 2, "avg": 4, "median": 4, "std": 3}


def _rounded(df: DataFrame, op: str) -> DataFrame:
    return df.withColumn(op, F.round(op, _DIGITS[op])) if op in _DIGITS else df


for _op, (_expr, _shape) in _AGG.items():
    _arg = None if _op == "count" else "o_totalprice"
    named(f"agg_{_op}", lambda spark, sf_dir, o=_op, a=_arg: _rounded(data(spark, sf_dir, "orders").aggregate(o, a).to_df(), o), f'SELECT {_shape.format(_expr)} AS "{_op}" FROM orders')
    named(f"group_{_op}", lambda spark, sf_dir, o=_op, a=_arg: _rounded(data(spark, sf_dir, "orders").group("o_orderpriority").aggregate(o, a).to_df(), o), f'SELECT o_orderpriority, {_shape.format(_expr)} AS "{_op}" FROM orders GROUP BY 1')


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def group_records(spark, sf_dir):
    out = data(spark, sf_dir, "nation").sort("n_nationkey").group("n_regionkey").to_df()
    return out.select("n_regionkey", F.array_join(F.transform("records", lambda r: r["n_name"]), ",").alias("names"))


@query('SELECT coalesce(sum(o_totalprice), 0)::DOUBLE AS "sum" FROM orders WHERE o_totalprice < 0')
def agg_empty(spark, sf_dir):
    return data(spark, sf_dir, "orders").where({"field": "o_totalprice", "op": "<", "value": 0}).sum("o_totalprice").to_df()


# -- set algebra ------------------------------------------------------------------------------------------------------------------------------


def _sides(spark, sf_dir):
    s = data(spark, sf_dir, "orders")
    return tuple(s.where({"field": "o_orderstatus", "op": "=", "value": v}).project("o_custkey") for v in "FO")


_F, _O = ("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
for _name, _op, _sql in (
    ("set_union", "union", f"{_F} UNION {_O}"), ("set_intersection", "intersection", f"{_F} INTERSECT {_O}"), ("set_difference", "difference", f"{_F} EXCEPT {_O}"),
    ("set_symmetric_difference", "symmetric_difference", f"({_F} EXCEPT {_O}) UNION ({_O} EXCEPT {_F})"),
):
    named(_name, lambda spark, sf_dir, o=_op: (lambda a, b: getattr(a, o)(b).to_df())(*_sides(spark, sf_dir)), _sql)


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def product(spark, sf_dir):
    out = data(spark, sf_dir, "region").product(data(spark, sf_dir, "nation")).to_df()
    return out.select(F.col("left.r_name").alias("r_name"), F.col("right.n_name").alias("n_name"))


# -- references -------------------------------------------------------------------------------------------------------------------------------


def _linked(spark, sf_dir) -> Engine:
    """customers and orders with references to what they belong to."""
    engine = Engine(spark)
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    data(spark, sf_dir, "nation", engine, identity=("n_nationkey",))
    engine.register("customer", read("customer").withColumnRenamed("c_nationkey", "nation"), identity=("c_custkey",), references={"nation": "nation"})
    engine.register("orders", read("orders").withColumnRenamed("o_custkey", "customer"), identity=("o_orderkey",), references={"customer": "customer"})
    return engine


@query("SELECT o_orderkey, c_name AS customer_name, n_name AS nation_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def nested_projection(spark, sf_dir):
    out = Session(_linked(spark, sf_dir)).execute("orders().(o_orderkey, customer(c_name, nation(n_name)))").to_df()
    return out.select("o_orderkey", F.col("customer.c_name").alias("customer_name"), F.col("customer.nation.n_name").alias("nation_name"))


# -- vectors ----------------------------------------------------------------------------------------------------------------------------------

_VECTOR = [round(0.05 * ((i * 7) % 13 - 6), 2) for i in range(64)]


def _nearest(spark, sf_dir, metric):
    s = data(spark, sf_dir, "embeddings", kind="vector").similarity("embedding", _VECTOR, metric=metric).sort("vec_id")
    s = s.order("_distance").limit(10).project("vec_id", "_distance")
    return s.to_df().withColumn("_distance", F.round("_distance", 6))


named("vec_cosine", lambda spark, sf_dir: _nearest(spark, sf_dir, "cosine"), f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], {_VECTOR}::DOUBLE[]), 6) AS _distance FROM embeddings ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], {_VECTOR}::DOUBLE[]), vec_id LIMIT 10")
named("vec_euclid", lambda spark, sf_dir: _nearest(spark, sf_dir, "euclidean"), f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_VECTOR}::DOUBLE[]), 6) AS _distance FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_VECTOR}::DOUBLE[]), vec_id LIMIT 10")


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_VECTOR}::DOUBLE[]), 6) AS _distance FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_VECTOR}::DOUBLE[]), vec_id LIMIT 15 OFFSET 5")
def vec_distance(spark, sf_dir):
    s = data(spark, sf_dir, "embeddings", kind="vector").distance("embedding", _VECTOR).sort("vec_id").order("_distance").offset(5).limit(15)
    return s.project("vec_id", "_distance").to_df().withColumn("_distance", F.round("_distance", 6))


# -- graphs -----------------------------------------------------------------------------------------------------------------------------------


def _turns(spark, sf_dir) -> Selection:
    engine = Engine(spark)
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", "role").distinct()
    s = engine.register("turns", c, kind="graph")
    step = c.select(F.lit("next").alias("label"), F.col("id").alias("source"), (F.col("id") + 1).alias("target")).join(c.select(F.col("id").alias("target")), "target", "left_semi")
    engine.register_links("turns", step)
    return engine.select("turns") if s else s


@query("SELECT DISTINCT conv_id, turn FROM conversations c WHERE turn BETWEEN 1 AND 3 AND (SELECT count(DISTINCT turn) FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn < c.turn) = c.turn")
def bfs_path(spark, sf_dir):
    return _turns(spark, sf_dir).where({"field": "turn", "op": "=", "value": 0}).traverse("next", depth=3).project("conv_id", "turn").to_df()


def _supplies(spark, sf_dir, path: str | None = None) -> Engine:
    """Suppliers (ids below zero) and parts, linked both ways where a line has them."""
    engine = Engine(spark, path)
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    links = li.groupBy((-F.col("l_suppkey") - 1).alias("source"), F.col("l_partkey").alias("target")).agg(F.max("l_quantity").alias("quantity")).withColumn("label", F.lit("supplies")).withColumn("bidir", F.lit(True))
    nodes = links.select(F.col("source").alias("id")).union(links.select("target")).distinct().withColumn("kind", F.when(F.col("id") < 0, "supplier").otherwise("part"))
    engine.register("market", nodes, kind="graph")
    engine.register_links("market", links)
    return engine


_STEPS = """WITH e AS (SELECT -l_suppkey - 1 AS s, l_partkey AS p, max(l_quantity) AS q FROM lineitem GROUP BY ALL), k AS (SELECT s, p FROM e WHERE q >= 49),
    l1 AS (SELECT DISTINCT p AS id FROM k WHERE s = -2), l2 AS (SELECT DISTINCT s AS id FROM k WHERE p IN (SELECT id FROM l1) AND s <> -2),
    l3 AS (SELECT DISTINCT p AS id FROM k WHERE s IN (SELECT id FROM l2) AND p NOT IN (SELECT id FROM l1))"""


@query(f"{_STEPS} SELECT id FROM l1 UNION ALL SELECT id FROM l2 UNION ALL SELECT id FROM l3")
def bfs_bipartite(spark, sf_dir):
    return Session(_supplies(spark, sf_dir)).execute("market({id=-2}).traverse(supplies({quantity>=49}), depth=3).(id)").to_df()


@query(f"{_STEPS} SELECT id FROM l2")
def bfs_then_where(spark, sf_dir):
    return Session(_supplies(spark, sf_dir)).execute('market({id=-2}).traverse(supplies({quantity>=49}), depth=3).where({kind="supplier"}).(id)').to_df()


# -- key/value, mutations, constraints --------------------------------------------------------------------------------------------------------


@query("SELECT event_id AS key, props AS value FROM events WHERE event_id IN (3, 5, 8)")
def kv_lookup(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("key"), F.col("props").alias("value"))
    return Engine(spark).register("props", e, kind="kv").where({"field": "key", "op": "in", "value": [3, 5, 8]}).to_df()


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey + 100, r_name FROM region")
def insert_select(spark, sf_dir):
    engine = Engine(spark)
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    engine.create_dataset("places", "table", {"id": {"type": "int", "constraints": ["pk"]}, "name": "text"})
    for s in (read("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")), read("region").select((F.col("r_regionkey") + 100).cast("long").alias("id"), F.col("r_name").alias("name"))):
        engine.insert_selection("places", engine.register(f"from{len(engine.current)}", s))
    return engine.select("places").to_df().select(F.col("id").alias("n_nationkey"), F.col("name").alias("n_name"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'X' ELSE n_name END AS n_name FROM nation")
def update(spark, sf_dir):
    s = session(spark, sf_dir, "nation")
    s.execute('nation({n_regionkey=1}).update({n_name="X"})')
    return s.execute("nation().(n_nationkey, n_name)").to_df()


@query("SELECT n_nationkey FROM nation WHERE NOT (n_regionkey = 2 OR n_name LIKE 'A%')")
def delete(spark, sf_dir):
    s = session(spark, sf_dir, "nation")
    s.execute('nation({n_regionkey=2 || n_name startsWith "A"}).delete()')
    return s.execute("nation().(n_nationkey)").to_df()


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1")
def violations_pk(spark, sf_dir):
    """The records that the primary key of a new dataset refuses."""
    engine = Engine(spark)
    number = {"type": "int", "constraints": ["pk"]}
    engine.create_dataset("lines", "table", {"l_orderkey": number, "l_linenumber": number, "l_partkey": "int"})
    refused = engine.violations("lines", data(spark, sf_dir, "lineitem", engine).project("l_orderkey", "l_linenumber", "l_partkey"))
    return refused.where("code = 'primary_key'").select("row.*").withColumn("l_linenumber", F.col("l_linenumber").cast("int"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def violations_fk(spark, sf_dir):
    """The records whose references lead nowhere."""
    engine = Engine(spark)
    engine.register("customer", spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_nationkey < 5"), identity=("c_custkey",))
    engine.create_dataset("sales", "table", {"o_orderkey": {"type": "int", "constraints": ["pk"]}, "o_custkey": "customer"})
    refused = engine.violations("sales", data(spark, sf_dir, "orders", engine).project("o_orderkey", "o_custkey"))
    return refused.where("code = 'missing_reference'").select(F.col("row.o_orderkey").alias("o_orderkey"))


@query("SELECT o_orderkey, c_name AS customer_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def insert_references(spark, sf_dir):
    """A selection whose keys become references; they are checked by a join."""
    engine = _linked(spark, sf_dir)
    engine.create_dataset("sales", "table", {"o_orderkey": {"type": "int", "constraints": ["pk"]}, "o_custkey": "customer"})
    engine.insert_selection("sales", data(spark, sf_dir, "orders", Engine(spark)).where({"field": "o_totalprice", "op": ">", "value": 300000}).project("o_orderkey", "o_custkey"))
    return Session(engine).execute("sales().(o_orderkey, o_custkey(c_name))").to_df().select("o_orderkey", F.col("o_custkey.c_name").alias("customer_name"))


@query("SELECT event_id AS key, CASE WHEN event_id % 500 = 0 THEN 'seen' ELSE event_type END AS value FROM events WHERE event_id <> 7 UNION ALL SELECT -5, 'new'")
def kv_upsert(spark, sf_dir):
    """Keys that are set over registered pairs, one of them twice, one new, and one deleted."""
    engine = Engine(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("key"), F.col("event_type").alias("value"))
    engine.register("kinds", e, kind="kv")
    every = [r["key"] for r in e.where("key % 500 = 0").select("key").collect()]
    engine.insert("kinds", [{"key": k, "value": "once"} for k in every])
    engine.insert("kinds", [{"key": k, "value": "seen"} for k in [*every, -5]])
    engine.kv("kinds").set(-5, "new")
    engine.kv("kinds").delete(7)
    return engine.select("kinds").to_df()


@query("SELECT n_name FROM nation WHERE n_regionkey IN (1, 3) UNION ALL SELECT 'Atlantis'")
def graph_links(spark, sf_dir):
    """Nodes and links that are added one by one, beside links of a table."""
    engine = Engine(spark)
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    nodes = nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")).unionByName(region.select((-F.col("r_regionkey") - 1).cast("long").alias("id"), F.col("r_name").alias("name")))
    engine.register("places", nodes, kind="graph")
    engine.register_links("places", nation.select(F.lit("has").alias("label"), (-F.col("n_regionkey") - 1).cast("long").alias("source"), F.col("n_nationkey").cast("long").alias("target")))
    engine.insert("places", {"id": 900, "name": "Atlantis"})
    one = lambda i: engine.select("places").where({"field": "id", "op": "=", "value": i})
    engine.add_link(one(-2), one(900), label="has")
    engine.add_link(one(900), one(-4), label="near", bidir=True)
    start = engine.select("places").where({"field": "id", "op": "in", "value": [-2, -4]})
    return start.traverse("has").project("name").to_df().withColumnRenamed("name", "n_name")


@query("SELECT code FROM (VALUES ('primary_key'), ('unique'), ('required'), ('null'), ('type'), ('unknown_field'), ('readonly'), ('reference_in_use'), ('missing_reference')) t(code)")
def constraint_codes(spark, sf_dir):
    """What each kind of wrong record or change is refused for."""
    from .errors import DiagnosticError

    s = session(spark, sf_dir, "nation")
    s.execute("create dataset ports(table{id(int, pk), code(str(3), unique), depth(float), owner(str(9), readonly, default('none'))})")
    s.execute("create dataset calls(table{id(int, pk), port(ports)})")
    s.execute('add {id=1, code="abc", depth=4}, {id=2, code="abd", depth=5} into ports')
    s.execute("add {id=1, port=1} into calls")
    wrong = (
        'add {id=1, code="x", depth=1} into ports', 'add {id=3, code="abc", depth=1} into ports', 'add {id=3, code="x"} into ports', 'add {id=3, code=null, depth=1} into ports', 'add {id=3, code="long", depth=1} into ports',
        'add {id=3, code="x", depth=1, hue=2} into ports', 'ports({id=1}).update({owner="other"})', "ports({id=1}).delete()", "add {id=2, port=9} into calls",
    )
    found = []
    for statement in wrong:
        try:
            s.execute(statement)
        except DiagnosticError as e:
            found.append((e.code,))
    return spark.createDataFrame(found, "code string")


@query("SELECT 3 AS size, 2.5::DOUBLE AS distance, 'AB' AS up, 'ab' AS low, TRUE AS has, 42::BIGINT AS number, 6::BIGINT AS items")
def builtin_functions(spark, sf_dir):
    s = session(spark, sf_dir, "region")
    got = [s.execute(q) for q in ("len('abc')", "abs(-2.5)", "upper('ab')", "lower('AB')", "contains([1, 2], 2)", "cast('42', int)", "len(list(1, 2, 2, 3, 3, 3))")]
    return spark.createDataFrame([tuple(got)], "size int, distance double, up string, low string, has boolean, number long, items long")


# -- the language -----------------------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) OR o_orderpriority = '5-LOW' ORDER BY o_orderkey LIMIT 40")
def ql_session(spark, sf_dir):
    results = session(spark, sf_dir, "orders").script("""
        function costly(least) { orders({o_orderstatus="F", o_totalprice > least}) }
        low = orders({o_orderpriority="5-LOW"})
        both = costly(200000) + low   # a union
        both().sort(o_orderkey).limit(40).(o_orderkey)
    """)
    return results[-1].to_df()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC LIMIT 10 OFFSET 5")
def dataset_options(spark, sf_dir):
    return session(spark, sf_dir, "orders").execute('orders({o_orderstatus="P"}, {select=[o_orderkey, o_totalprice], order=[o_totalprice, desc], offset=5, limit=10})').to_df()


@query("SELECT 'remove_zero_offset' AS rule")
def explain(spark, sf_dir):
    e = session(spark, sf_dir, "orders").execute("orders({o_orderkey=1}).(o_orderkey).offset(0).limit(5).limit(2).explain()")
    return spark.createDataFrame([(r,) for r in e["rules"]], "rule string")


@query("SELECT count(*) AS \"count\" FROM nation")
def transaction_rollback(spark, sf_dir):
    s = session(spark, sf_dir, "nation")
    s.execute("begin")
    s.execute("nation({n_regionkey=1}).delete()")
    s.execute("abort")
    return s.execute("nation().count()").to_df()


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 3")
def recover(spark, sf_dir):
    import uuid

    from .sources.files import shared_dir

    path = f"{shared_dir(spark)}/engine-{uuid.uuid4().hex}"
    engine = Engine(spark, path)
    data(spark, sf_dir, "nation", engine)
    engine.delete("nation", {"field": "n_regionkey", "op": "=", "value": 3})
    return Engine(spark, path).select("nation").project("n_nationkey", "n_name").to_df()


@query(f"{_STEPS} SELECT id FROM l1 UNION ALL SELECT id FROM l2")
def recover_graph(spark, sf_dir):
    """Links of a table, with typed data, through a restart."""
    import uuid

    from .sources.files import shared_dir

    path = f"{shared_dir(spark)}/engine-{uuid.uuid4().hex}"
    _supplies(spark, sf_dir, path)
    return Session(Engine(spark, path)).execute("market({id=-2}).traverse(supplies({quantity>=49}), depth=2).(id)").to_df()


@query("SELECT event_id, event_type, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE value > 50")
def stream_expand(spark, sf_dir):
    """The row-wise operators over a stream that ends with the file."""
    import uuid

    from . import streaming
    from .sources.files import shared_dir

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    s = streaming.selection("events", stream, **PROPS)
    from .functions.types import QLType

    s.source.fields["props"] = QLType("json")
    s = s.where({"field": "value", "op": ">", "value": 50}).project("event_id", "event_type", "props").expand("props")
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = streaming.to_stream(s).writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.parquet(out)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
