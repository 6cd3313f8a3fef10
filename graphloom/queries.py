"""The registered template queries over the star schema, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.render import DATABASE, guid, guid_text
from .operators import idsets, verify, writes
from .plans.compiler import compile_read
from .plans.parser import parse
from .sources import primitives, stored
from .sources.relational import EVENTS, SHIFT, TABLES, TYPES, EventStore, TableStore, node_id, node_number

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str]] = {}


def run(store, text: str) -> DataFrame:
    """A read request as a flat table, without the default page."""
    compiler, root = compile_read(store, parse(text), default_page=None)
    return compiler.table(root)


def _template(name: str, text: str, sql: str, columns: dict[str, str] | None = None, store=TableStore) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(store(spark, sf_dir), text).withColumnsRenamed(columns or {})

    query.__name__ = name
    _QUERIES[name] = (query, sql)


def _frame(name: str, sql: str):
    def keep(f: Query) -> Query:
        _QUERIES[name] = (f, sql)
        return f

    return keep


def _id(table: str, key: str) -> str:
    return f"(({TYPES[table]}::BIGINT << {SHIFT}) + {key})"


def _guid(table: str, key: str) -> str:
    return f"('{DATABASE}' || lpad(lower(to_hex({_id(table, key)})), 15, '0'))"


def _money(c: str) -> str:
    return f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)"


_CUSTOMER, _ORDER, _NATION, _PART = _guid("customer", "c_custkey"), _guid("orders", "o_orderkey"), _guid("nation", "n_nationkey"), _guid("part", "p_partkey")
_DAY = "strftime(o_orderdate, '%Y-%m-%d')"

# --- scans and predicates

_template("q_scan_type", 'read ("nation" result=((guid name)))', f"SELECT {_NATION} AS guid, n_name AS name FROM nation")
_template("q_value_eq", 'read ("customer.c_mktsegment" value="BUILDING" result=((left value)))', f"""SELECT {_CUSTOMER} AS "left", c_mktsegment AS value FROM customer WHERE c_mktsegment = 'BUILDING'""")
_template("q_value_in", 'read ("customer.c_mktsegment" value=("BUILDING" "MACHINERY") result=((left value)))', f"""SELECT {_CUSTOMER} AS "left", c_mktsegment AS value FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
_template("q_value_ne", 'read ("customer.c_mktsegment" value!="BUILDING" result=((left value)))', f"""SELECT {_CUSTOMER} AS "left", c_mktsegment AS value FROM customer WHERE c_mktsegment <> 'BUILDING'""")
_template("q_value_range_number", 'read ("part.p_retailprice" value-comparator="number" value>="950" value<"960.5" result=((left value)))', f"""SELECT {_PART} AS "left", {_money("p_retailprice")} AS value FROM part WHERE CAST(p_retailprice AS DECIMAL(18,2)) >= 950 AND CAST(p_retailprice AS DECIMAL(18,2)) < 960.5""")
_template("q_value_range_default", 'read ("orders.o_orderpriority" value>="2" value<"4" result=((left value)))', f"""SELECT {_ORDER} AS "left", o_orderpriority AS value FROM orders WHERE o_orderpriority >= '2' AND o_orderpriority < '4'""")
_template("q_value_octet", 'read ("part.p_brand" comparator="octet" value>="Brand#2" value<"Brand#3" result=((left value)))', f"""SELECT {_PART} AS "left", p_brand AS value FROM part WHERE p_brand >= 'Brand#2' AND p_brand < 'Brand#3'""")
_template("q_value_case", 'read ("customer.c_mktsegment" comparator="case-insensitive" value="building" result=((left value)))', f"""SELECT {_CUSTOMER} AS "left", c_mktsegment AS value FROM customer WHERE lower(c_mktsegment) = 'building'""")
_template("q_value_number_exact", 'read ("part.p_brand" value="Brand#007" result=((left value)))', f"""SELECT {_PART} AS "left", p_brand AS value FROM part WHERE p_brand = 'Brand#7'""")
_template("q_datetime_range", 'read ("orders.o_orderdate" value-comparator="datetime" value>="1995-06" value<"1996" result=((left value)))', f"""SELECT {_ORDER} AS "left", {_DAY} AS value FROM orders WHERE {_DAY} >= '1995-06' AND {_DAY} < '1996'""")
_template("q_glob_word", 'read ("part" name~="ring" result=((guid name)))', f"""SELECT {_PART} AS guid, p_name AS name FROM part WHERE regexp_matches(p_name, '\\bring\\b')""")
_template("q_glob_prefix", 'read ("part" name~="sm* g*" result=((guid name)))', f"""SELECT {_PART} AS guid, p_name AS name FROM part WHERE regexp_matches(p_name, '\\bsm[a-z]* g')""")
_template("q_glob_anchor", 'read ("part" name~="^small" result=((guid name)))', f"""SELECT {_PART} AS guid, p_name AS name FROM part WHERE p_name LIKE 'small %'""")
_template("q_null_value", 'read (type=("nation.n_regionkey" "nation.n_name") value=null result=((left right)))', f"""SELECT {_NATION} AS "left", {_guid("region", "n_regionkey")} AS "right" FROM nation""")
_template("q_guid_in", f'read (guid=({" ".join(guid_text(node_number("customer", k)) for k in (1, 7, 42))}) "customer" result=((guid name)))', f"SELECT {_CUSTOMER} AS guid, c_name AS name FROM customer WHERE c_custkey IN (1, 7, 42)")
_template("q_guid_not_in", f'read (guid!=({" ".join(guid_text(node_number("nation", k)) for k in (1, 7))}) "nation" result=((guid name)))', f"SELECT {_NATION} AS guid, n_name AS name FROM nation WHERE n_nationkey NOT IN (1, 7)")
_template("q_dateline", f'read ("orders" dateline<"db.{node_number("orders", 500)}" dateline>"db.{node_number("orders", 100)}" result=((guid)))', f"SELECT {_ORDER} AS guid FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 500")
_template("q_valuetype", 'read (type=("region.r_name" "nation.n_regionkey") valuetype=2 result=((value datatype valuetype)))', "SELECT r_name AS value, 'string' AS datatype, CAST(2 AS SMALLINT) AS valuetype FROM region")
_template("q_text_search_docs", 'read ("documents.text" value~="the*" value~="^and" result=((left)))', f"""SELECT {_guid("documents", "doc_id")} AS "left" FROM documents
  WHERE regexp_matches(lower(text), '(^|[^0-9a-z\\x{{80}}-\\x{{10FFFF}}])the') AND regexp_matches(lower(text), '^[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]*and([^0-9a-z\\x{{80}}-\\x{{10FFFF}}]|$)')""")  # fmt: skip

# --- joins

_template("q_join_my", 'read ("nation" result=((name $cust)) (<-right "customer.c_nationkey" count>=1 sort=left pagesize=1 $cust=left))', f"""SELECT n_name AS name, {_guid("customer", "min(c_custkey)")} AS cust FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name""")
_template("q_join_iam", 'read ("orders.o_custkey" result=((left $name)) right->("customer" $name=name))', f"""SELECT {_ORDER} AS "left", c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey""")
_template("q_join_chain3", 'read ("customer.c_nationkey" result=((left $nation $region)) right->("nation" $nation=name (<-left "nation.n_regionkey" right->("region" $region=name))))', f"""SELECT {_CUSTOMER} AS "left", n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
_template("q_join_arrow_from", 'read ("nation" result=((name $region)) (-> "nation.n_regionkey" ("region" $region=name)))', "SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
_template("q_join_arrow_to", 'read ("region" result=((name $n)) (<- "nation.n_regionkey" sort=left pagesize=1 ("nation" $n=name)))', "SELECT r_name AS name, arg_min(n_name, n_nationkey) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
_template("q_semi", 'read ("customer" result=((guid)) (<-right "orders.o_custkey" left->("orders" (<-left "orders.o_orderstatus" value="P"))))', f"SELECT {_CUSTOMER} AS guid FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
_template("q_optional", 'read ("part" result=((guid $big)) (<-left optional "part.p_size" value-comparator="number" value>="45" $big=value))', f"SELECT {_PART} AS guid, CASE WHEN p_size >= 45 THEN CAST(p_size AS VARCHAR) END AS big FROM part")
_template("q_anti", 'read ("part" result=((guid)) (<-right "lineitem.l_partkey" left->("lineitem" (<-left "lineitem.l_quantity" value="50.00")) count=0))', f"SELECT {_PART} AS guid FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity = 50)")
_template("q_not_exists_twice", 'read ("nation" result=((name)) (<-right "customer.c_nationkey" count=0 left->("customer" (<-right "orders.o_custkey" count=0))))', """SELECT n_name AS name FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey))""")

# --- counts, samples, lists

_template("q_count_eq", 'read ("customer" result=((guid)) (<-right "orders.o_custkey" count=10))', f"SELECT {_CUSTOMER} AS guid FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(*) = 10")
_template("q_count_range", 'read ("customer" result=((guid)) (<-right "orders.o_custkey" count>=3 count<6))', f"SELECT {_CUSTOMER} AS guid FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(*) BETWEEN 3 AND 5")
_template("q_count_at_most", 'read ("customer" result=((guid)) (<-right "orders.o_custkey" count<=5))', f"SELECT {_CUSTOMER} AS guid FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) <= 5")
_template("q_count_result", 'read ("customer" result=((guid contents)) (<-right optional "orders.o_custkey" result=count))', f"SELECT {_CUSTOMER} AS guid, nullif(count(o_orderkey), 0) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
_template("q_countlimit", 'read ("customer" result=((guid contents)) (<-right "orders.o_custkey" countlimit=8 result=count))', f"SELECT {_CUSTOMER} AS guid, least(count(*), 8) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
_template("q_count_all", 'read ("orders" result=(count))', "SELECT count(*) AS count FROM orders")
_MIN = 'read ("orders" result=((guid $price)) (<-right "lineitem.l_orderkey" left->("lineitem" (<-left "lineitem.l_extendedprice" $p=value)) sort=%s$p sort-comparator="number" $price=$p))'
_template("q_sample_min", _MIN % "", f"SELECT {_guid('orders', 'l_orderkey')} AS guid, CAST(min(CAST(l_extendedprice AS DECIMAL(18,2))) AS VARCHAR) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey")
_template("q_sample_max", _MIN % "-", f"SELECT {_guid('orders', 'l_orderkey')} AS guid, CAST(max(CAST(l_extendedprice AS DECIMAL(18,2))) AS VARCHAR) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey")


@_frame("q_collect", "SELECT r_name AS region, count(*) AS n, string_agg(n_name, ',' ORDER BY n_nationkey) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def q_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(TableStore(spark, sf_dir), 'read ("region" result=((name $all)) (<-right "nation.n_regionkey" sort=left pagesize=1024 left->("nation" $n=name) $all=(($n))))')
    names = F.transform("all.f0", lambda x: x["f0"])
    return rows.select(F.col("name").alias("region"), F.size(names).cast("long").alias("n"), F.array_join(names, ",").alias("nations"))


# --- OR, variables

_template("q_or_values", 'read ("customer.c_mktsegment" {value="BUILDING"} | {value="HOUSEHOLD"} result=((left value)))', f"""SELECT {_CUSTOMER} AS "left", c_mktsegment AS value FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD')""")
_template("q_or_subcon", 'read ("part" { (<-left "part.p_type" value="PROMO") } || { (<-left "part.p_brand" value="Brand#2") } result=((guid)))', f"SELECT {_PART} AS guid FROM part WHERE p_type = 'PROMO' OR p_brand = 'Brand#2'")
_template("q_or_vars", 'read ("part" { (<-left "part.p_type" value="PROMO" $a=value) } || { (<-left "part.p_brand" value="Brand#2" $b=value) } result=((guid $a $b)))', f"SELECT {_PART} AS guid, CASE WHEN p_type = 'PROMO' THEN p_type END AS a, CASE WHEN p_type <> 'PROMO' THEN p_brand END AS b FROM part WHERE p_type = 'PROMO' OR p_brand = 'Brand#2'")
_template("q_var_alias", 'read ("customer" result=((name $segment)) (<-left "customer.c_mktsegment" $segment=value))', "SELECT c_name AS name, c_mktsegment AS segment FROM customer")
_template("q_var_chain", 'read ("customer.c_nationkey" result=((left $a)) $a=$b right->("nation" $b=$c (<-left "nation.n_regionkey" $c=$d right->("region" $d=name))))', f"""SELECT {_CUSTOMER} AS "left", r_name AS a FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")

# --- order and pages

_template("q_sort_multi", 'read ("customer.c_mktsegment" sort=(value -left) pagesize=50 result=((value left)))', f"""SELECT c_mktsegment AS value, {_CUSTOMER} AS "left" FROM customer ORDER BY c_mktsegment, c_custkey DESC LIMIT 50""")
_template("q_sort_desc_null", 'read ("part" (<-left optional "part.p_size" value-comparator="number" value>="45" $big=value) sort=-$big pagesize=40 result=((guid $big)))', f"SELECT {_PART} AS guid, CASE WHEN p_size >= 45 THEN CAST(p_size AS VARCHAR) END AS big FROM part ORDER BY CASE WHEN p_size >= 45 THEN p_size END DESC NULLS FIRST, p_partkey LIMIT 40")
_template("q_sort_var", 'read ("orders" sort=-$price sort-comparator="number" pagesize=25 result=((guid $price)) (<-left "orders.o_totalprice" $price=value))', f"SELECT {_ORDER} AS guid, {_money('o_totalprice')} AS price FROM orders ORDER BY CAST(o_totalprice AS DECIMAL(18,2)) DESC, o_orderkey LIMIT 25")
_template("q_sort_fuzzy", 'read ("part.p_brand" sort=value pagesize=300 result=((value left)))', f"""SELECT p_brand AS value, {_PART} AS "left" FROM part ORDER BY CAST(substr(p_brand, 7) AS INTEGER), p_partkey LIMIT 300""")
_template("q_start_pagesize", 'read ("nation" sort=name start=5 pagesize=10 result=((guid name)))', f"SELECT {_NATION} AS guid, n_name AS name FROM nation ORDER BY n_nationkey LIMIT 10 OFFSET 5")
_template("q_cursor_page2", f'read ("nation" sort=name pagesize=10 cursor="{{\\"after\\": {node_number("nation", 9)}}}" result=((guid name)))', f"SELECT {_NATION} AS guid, n_name AS name FROM nation ORDER BY n_nationkey LIMIT 10 OFFSET 10")


@_frame("q_child_pagesize", """SELECT n_name AS nation, string_agg(c_name, ',' ORDER BY c_custkey) AS customers
    FROM (SELECT n_name, c_name, c_custkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS r FROM nation JOIN customer ON c_nationkey = n_nationkey)
    WHERE r BETWEEN 2 AND 4 GROUP BY n_name""")  # fmt: skip
def q_child_pagesize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(TableStore(spark, sf_dir), 'read ("nation" result=((name $all)) (<-right "customer.c_nationkey" sort=left start=1 pagesize=3 left->("customer" $n=name) $all=(($n))))')
    return rows.select(F.col("name").alias("nation"), F.array_join(F.transform("all.f0", lambda x: x["f0"]), ",").alias("customers"))


# --- versions

_EVENT = _guid(EVENTS, "event_id")
_VERSIONS = f"""(SELECT *, {_money("value")} AS text, value <= 40 AS live, row_number() OVER w - 1 AS generation, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) - 1 AS age,
  lag(event_id) OVER w AS p, lead(event_id) OVER w AS n FROM events %s WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id))"""
_template("q_newest", 'read ("event" result=((guid name value)))', f"SELECT {_EVENT} AS guid, event_type AS name, text AS value FROM {_VERSIONS % ''} WHERE age = 0 AND live", store=EventStore)
_template("q_oldest", 'read ("event" oldest=0 live=dontcare result=((guid name value)))', f"SELECT {_EVENT} AS guid, event_type AS name, text AS value FROM {_VERSIONS % ''} WHERE generation = 0", store=EventStore)
_template("q_generation", 'read ("event" newest>=1 newest<3 live=dontcare result=((guid generation)))', f"SELECT {_EVENT} AS guid, CAST(generation AS BIGINT) AS generation FROM {_VERSIONS % ''} WHERE age IN (1, 2)", store=EventStore)
_template("q_prev_next", 'read ("event" newest>=0 live=dontcare result=((guid previous next)))', f"SELECT {_EVENT} AS guid, {_guid(EVENTS, 'p')} AS previous, {_guid(EVENTS, 'n')} AS next FROM {_VERSIONS % ''}", store=EventStore)
_template("q_asof", f'read asof="db.{node_number(EVENTS, 5000)}" ("event" result=((guid value generation)))', f"SELECT {_EVENT} AS guid, text AS value, CAST(generation AS BIGINT) AS generation FROM {_VERSIONS % 'WHERE event_id < 5000'} WHERE age = 0 AND live", store=EventStore)
_template("q_tombstone", 'read ("event" live=false result=((guid live)))', f"SELECT {_EVENT} AS guid, live FROM {_VERSIONS % ''} WHERE age = 0 AND NOT live", store=EventStore)
_template("q_lineage_match", f'read (guid~={guid_text(node_number(EVENTS, 3))} newest>=0 live=dontcare result=((guid generation)))', f"SELECT {_EVENT} AS guid, CAST(generation AS BIGINT) AS generation FROM {_VERSIONS % ''} WHERE (user_id, event_type) IN (SELECT (user_id, event_type) FROM events WHERE event_id = 3)", store=EventStore)
_template("q_ts_range", f'read ("event" newest>=0 live=dontcare timestamp>="1970-01-01" dateline>"db.{node_number(EVENTS, 9000)}" result=((guid)))', f"SELECT {_EVENT} AS guid FROM events WHERE event_id >= 9000", store=EventStore)

# --- projections

_template("q_meta", 'read (type=("region" "nation.n_regionkey") result=((meta guid)))', f"SELECT 'node' AS meta, {_guid('region', 'r_regionkey')} AS guid FROM region UNION ALL SELECT '->', {_guid('nation.n_regionkey', 'n_nationkey')} FROM nation")
_template("q_literal", 'read ("region" result=((literal="area" name type)))', "SELECT 'area' AS literal, r_name AS name, 'region' AS type FROM region")
_template("q_default_result", 'read ("nation")', f"""SELECT 'node' AS meta, {_NATION} AS guid, 'nation' AS type, n_name AS name, CAST(NULL AS VARCHAR) AS datatype, CAST(NULL AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS scope, true AS live, true AS archival,
  strftime(make_timestamp(({_id("nation", "n_nationkey")} >> 16) * 1000000), '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(({_id("nation", "n_nationkey")} & 65535) AS VARCHAR), 4, '0') || 'Z' AS timestamp,
  CAST(NULL AS VARCHAR) AS "right", CAST(NULL AS VARCHAR) AS "left", CAST(NULL AS VARCHAR) AS contents FROM nation""")  # fmt: skip

for _n in ("q_count_result", "q_countlimit"):  # the count is the only child's result
    _inner, _sql = _QUERIES[_n]
    _QUERIES[_n] = (lambda spark, sf_dir, f=_inner: f(spark, sf_dir).select("guid", F.col("contents.c0").alias("n")), _sql)


# --- id sets


def _links(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return TableStore(spark, sf_dir).scan(frozenset([TYPES[name]]))


def _segment(spark: SparkSession, sf_dir: str, value: str) -> DataFrame:
    return idsets.ids(_links(spark, sf_dir, "customer.c_mktsegment").filter(F.col("value") == value), "left")


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idsets.ids(_links(spark, sf_dir, "orders.o_custkey"), "right")


def _shown(ids: DataFrame) -> DataFrame:
    return ids.select(guid(F.col("id")).alias("guid"))


@_frame("q_union", f"SELECT {_CUSTOMER} AS guid FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def q_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(idsets.union(_segment(spark, sf_dir, "BUILDING"), _segment(spark, sf_dir, "MACHINERY"), _segment(spark, sf_dir, "BUILDING")))


@_frame("q_intersect", f"SELECT {_CUSTOMER} AS guid FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey IN (SELECT o_custkey FROM orders)")
def q_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(idsets.intersection(_segment(spark, sf_dir, "BUILDING"), _active(spark, sf_dir)))


@_frame("q_without", f"SELECT {_CUSTOMER} AS guid FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey <> 3")
def q_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = idsets.ids(_links(spark, sf_dir, "customer.c_nationkey").filter(F.col("right") == node_number("nation", 3)), "left")
    return _shown(idsets.without(_segment(spark, sf_dir, "BUILDING"), there))


@_frame("q_isa", f"SELECT DISTINCT {_guid('part', 'l_partkey')} AS guid FROM lineitem")
def q_isa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(idsets.isa(_links(spark, sf_dir, "lineitem.l_partkey"), "right"))


@_frame("q_linksto", f"""SELECT {_ORDER} AS "left" FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def q_linksto(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = idsets.linksto(_links(spark, sf_dir, "orders.o_custkey"), "right", _segment(spark, sf_dir, "BUILDING"))
    return found.select(guid(F.col("left")).alias("left"))


# --- writes, dump, verify: what would be written or reported


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' names and balances as a batch to be written onto the customers' of the same key."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.select(node_id("customer", F.col("s_suppkey") * 20).alias("left"), F.col("s_acctbal").cast("decimal(18,2)").cast("string").alias("value"))


@_frame("q_unique_guard", f"""SELECT {_guid("customer", "s_suppkey * 20")} AS "left", {_money("s_acctbal")} AS value FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = s_suppkey * 20)""")
def q_unique_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = writes.absent(_incoming(spark, sf_dir), _links(spark, sf_dir, "customer.c_acctbal"), ["left"])
    return fresh.select(guid(F.col("left")).alias("left"), "value")


@_frame("q_key_upsert", f"""SELECT {_guid("customer", "s_suppkey * 20")} AS "left", {_money("s_acctbal")} AS value,
    CASE WHEN c_custkey IS NULL THEN 'insert' WHEN {_money("c_acctbal")} = {_money("s_acctbal")} THEN 'keep' ELSE 'version' END AS action FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey * 20""")  # fmt: skip
def q_key_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = writes.keyed(_incoming(spark, sf_dir), _links(spark, sf_dir, "customer.c_acctbal"), ["left"], ["value"])
    return plan.select(guid(F.col("left")).alias("left"), "value", "action")


@_frame("q_anchor", f"""SELECT {_guid("customer", "s_suppkey * 20")} AS "left", count(c_custkey) AS found FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey * 20 GROUP BY s_suppkey""")
def q_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = writes.anchored(_incoming(spark, sf_dir).select("left"), _links(spark, sf_dir, "customer.c_acctbal"), ["left"])
    return found.select(guid(F.col("left")).alias("left"), "found")


@_frame("q_verify_dangling", f"""SELECT {_guid("customer.c_nationkey", "c_custkey")} AS guid, 'right' AS linkage, {_guid("nation", "c_nationkey")} AS target FROM customer WHERE c_nationkey >= 20""")
def q_verify_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = TableStore(spark, sf_dir)
    known = store.scan(frozenset([TYPES["nation"]])).filter(F.col("id") < node_number("nation", 20))
    found = verify.dangling(store.scan(frozenset([TYPES["customer.c_nationkey"]])), known, "right")
    return found.select(guid(F.col("id")).alias("guid"), "linkage", guid(F.col("target")).alias("target"))


_NODES = " + ".join(f"(SELECT count(*) FROM {t})" for t in TABLES)
_LINK_COUNT = " + ".join(f"(SELECT count({a.column if a.kind in TABLES else '*'}) FROM {t})" for t, x in TABLES.items() for a in x.attributes)


@_frame("q_status_database", f"SELECT CAST({_NODES} + {_LINK_COUNT} AS BIGINT) AS primitives, CAST({_NODES} + {_LINK_COUNT} AS BIGINT) AS live, CAST({_LINK_COUNT} AS BIGINT) AS links, CAST({_NODES} AS BIGINT) AS nodes, (SELECT max({_id('documents.lang', 'doc_id')}) + 1 FROM documents) AS next_id")
def q_status_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.counts(TableStore(spark, sf_dir).primitives)


def _primitive_sql(table: str, column: str | None) -> str:
    """The primitives of a keyed table's nodes or of one of its attributes, all columns."""
    x = TABLES[table]
    key, null = x.key, "CAST(NULL AS BIGINT)"
    ident = _id(f"{table}.{column}" if column else table, key)
    a = next((a for a in x.attributes if a.column == column), None)
    far = a is not None and a.kind in TABLES
    value = "CAST(NULL AS VARCHAR)" if a is None or far else {"number": _money(column), "date": f"strftime({column}, '%Y-%m-%d')"}.get(a.kind, f"CAST({column} AS VARCHAR)")
    return f"""SELECT {ident} AS id, CAST({TYPES[f"{table}.{column}" if column else table]} AS BIGINT) AS typeguid, {_id(a.kind, column) if far else null} AS "right", {_id(table, key) if a else null} AS "left", {null} AS scope, {null} AS prev,
        {f"CAST({x.name} AS VARCHAR)" if x.name and not a else "CAST(NULL AS VARCHAR)"} AS name, {value} AS value, CAST(CASE WHEN {value} IS NULL THEN 1 ELSE 2 END AS SMALLINT) AS valuetype, true AS live, true AS archival, true AS txstart, {ident} AS ts_raw, {ident} AS lineage
        FROM {table}{f" WHERE {column} IS NOT NULL" if far else ""}"""


_KEYED = [t for t, x in TABLES.items() if x.key]


@_frame("q_dump_restore", " UNION ALL ".join(_primitive_sql(t, c) for t in _KEYED for c in (None, *(a.column for a in TABLES[t].attributes))))
def q_dump_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node and attribute of the tables with a key (DuckDB cannot number the rows of others as files do), through text and back."""
    kinds = frozenset(TYPES[n] for n in TYPES if n.partition(".")[0] in _KEYED)
    return primitives.restore(primitives.dump(TableStore(spark, sf_dir).scan(kinds)))


@_frame("q_append_keyed", f"""WITH old AS (SELECT {_id("supplier.s_acctbal", "s_suppkey")} AS id, {_id("supplier", "s_suppkey")} AS "left", {_money("s_acctbal")} AS value, s_suppkey % 3 = 1 AS changed FROM supplier),
    new AS (SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY "left") AS id, "left", '0.00' AS value, id AS prev FROM old WHERE changed AND value <> '0.00')
  SELECT old.id, old."left", old.value, CAST(NULL AS BIGINT) AS prev, 0 AS generation, CASE WHEN new.id IS NULL THEN 0 ELSE 1 END AS from_latest FROM old LEFT JOIN new ON prev = old.id
  UNION ALL SELECT id, "left", value, prev, 1, 0 FROM new""")  # fmt: skip
def q_append_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of balances, keyed by supplier, appended to those at rest: a third is new, the others say what is there."""
    path = f"{primitives.shared(spark)}/stores/{uuid.uuid4().hex}"
    nodes, links = (TableStore(spark, sf_dir).scan(frozenset([TYPES[n]])) for n in ("supplier", "supplier.s_acctbal"))
    stored.save(nodes.unionByName(links), path, single=True)
    saved = stored.Saved(spark, path, TYPES)
    value = F.when(F.col("left") % 3 == (node_number("supplier", 0) + 1) % 3, "0.00").otherwise(F.col("value"))
    batch = links.select(*[f.name for f in primitives.SCHEMA if f.name not in ("id", "prev", "lineage")]).withColumn("value", value)
    writes.appended(saved, path, batch, key=["typeguid", "left"], order=["left"])
    after = stored.Saved(spark, path, TYPES).scan(frozenset([TYPES["supplier.s_acctbal"]]))
    return after.select("id", "left", "value", "prev", "generation", "from_latest")


# --- filters by ends, sets of bounds, neighbours in a lineage

_template("q_range_set", 'read ("orders.o_orderpriority" value>("1" "3") result=((left value)))', f"""SELECT {_ORDER} AS "left", o_orderpriority AS value FROM orders WHERE o_orderpriority >= '3'""")
_template("q_left_in", f'read ("customer.c_acctbal" left=({" ".join(guid_text(node_number("customer", k)) for k in (2, 3, 9999999))}) result=((left value)))', f"""SELECT {_CUSTOMER} AS "left", {_money("c_acctbal")} AS value FROM customer WHERE c_custkey IN (2, 3)""")
_template("q_right_not", f'read ("customer.c_nationkey" right!={guid_text(node_number("nation", 4))} result=((left right)))', f"""SELECT {_CUSTOMER} AS "left", {_guid("nation", "c_nationkey")} AS "right" FROM customer WHERE c_nationkey <> 4""")
_template("q_typeguid", f'read (typeguid={guid_text(TYPES["region"])} result=((guid name typeguid)))', f"SELECT {_guid('region', 'r_regionkey')} AS guid, r_name AS name, {guid_text(TYPES['region'])!r} AS typeguid FROM region")
_template("q_scope", f'read ("event" newest>=0 live=dontcare scope={guid_text(node_number("customer", 5))} result=((guid scope)))', f"SELECT {_EVENT} AS guid, {_guid('customer', 'user_id')} AS scope FROM events WHERE user_id = 5", store=EventStore)
_template("q_previous", f'read ("event" newest>=0 live=dontcare previous={guid_text(node_number(EVENTS, 3))} result=((guid generation)))', f"SELECT {_EVENT} AS guid, CAST(generation AS BIGINT) AS generation FROM {_VERSIONS % ''} WHERE p = 3", store=EventStore)
_template("q_next", f'read ("event" newest>=0 live=dontcare next!=null result=((guid)))', f"SELECT {_EVENT} AS guid FROM {_VERSIONS % ''} WHERE n IS NOT NULL", store=EventStore)
_template("q_false", 'read ("nation" false result=((name)))', "SELECT n_name AS name FROM nation WHERE false")
_template("q_any_node", f'read (any node typeguid={guid_text(TYPES["nation"])} name>="x" result=((name)))'.replace(' name>="x"', ' name!=("CHINA" null)'), "SELECT n_name AS name FROM nation WHERE n_name <> 'CHINA'")


FLAGSHIP = """read ("customer" sort=-$price sort-comparator="number" pagesize=100 result=((name $price $part))
  (<-right "orders.o_custkey" left->("orders"
    (<-left "orders.o_totalprice" $t=value)
    (<-right "lineitem.l_orderkey" left->("lineitem" (<-left optional "lineitem.l_partkey" right->("part" $pn=name))) sort=$pn $ln=$pn))
    sort=(-$t $ln) sort-comparator="number" $price=$t $part=$ln))"""
_template("q_flagship", FLAGSHIP, f"""WITH named AS (SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS total, min(p_name) AS part FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL),
  best AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY total DESC, lower(part), o_orderkey) AS r FROM named)
  SELECT c_name AS name, CAST(total AS VARCHAR) AS price, part FROM best JOIN customer ON c_custkey = o_custkey WHERE r = 1 ORDER BY total DESC, c_custkey LIMIT 100""")  # fmt: skip


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items()}
