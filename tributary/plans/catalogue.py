"""The registered queries, one for each operator, and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.scalars import draw_key, slot, typed_key
from tributary.operators import export, findings, inspect, policy, recipe, records, review, views
from tributary.plans.sqlpolicy import distinct_on, transform
from tributary.session import shared_dir
from tributary.sources import imports, media, readers, sinks

#: Bounded SQL: name -> (inputs, query); DuckDB runs the same text where no other is given below.
SQL = {
    "journey_features": ("events", "SELECT user_id AS id, COUNT(*) AS n, CAST(SUM(event_id) AS BIGINT) AS id_sum, SUM(CASE WHEN event_type = 'click' THEN 1.5 ELSE 0.5 END) AS weight, MAX(value) AS top, ROUND(AVG(value), 6) AS mean FROM events GROUP BY user_id ORDER BY id"),
    "sql_projection": ("orders", "SELECT o_orderkey AS id, o_totalprice * 2 AS twice, o_custkey % 7 AS part FROM orders ORDER BY id"),
    "sql_case": ("orders", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state, CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS large FROM orders ORDER BY id"),
    "sql_cast_decimal_round": ("part", "SELECT p_partkey AS id, CAST(p_size * 0.5 AS BIGINT) AS half FROM part ORDER BY id"),
    "sql_cast_double_round": ("orders", "SELECT o_orderkey AS id, CAST(o_totalprice / 2 AS BIGINT) AS half, TRY_CAST(o_orderstatus AS DOUBLE) AS number FROM orders ORDER BY id"),
    "sql_wildcard": ("nation", "SELECT nation.*, n_nationkey AS id FROM nation ORDER BY id"),
    "sql_where_between": ("orders", "SELECT o_orderkey AS id FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND NOT (o_orderstatus = 'P') ORDER BY id"),
    "sql_in_list": ("orders", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_custkey NOT IN (1, 2, 3) ORDER BY id"),
    "sql_in_subquery": ("orders customer", "SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) ORDER BY id"),
    "sql_not_in": ("orders customer", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) ORDER BY id"),
    "sql_exists": ("orders customer", "SELECT c_custkey AS id FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000) ORDER BY id"),
    "sql_correlated_scalar": ("orders customer", "SELECT c_custkey AS id, (SELECT MAX(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c ORDER BY id"),
    "sql_is_distinct": ("orders", "SELECT o_orderkey AS id, o_orderstatus IS NOT DISTINCT FROM 'F' AS f, o_orderstatus IS DISTINCT FROM NULL AS known FROM orders WHERE (o_totalprice > 1000) IS TRUE ORDER BY id"),
    "join_inner": ("customer nation", "SELECT c_custkey AS id, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY id"),
    "join_left": ("customer orders", "SELECT c_custkey AS cust, o_orderkey AS id FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 ORDER BY cust, id"),
    "join_right": ("customer orders", "SELECT c_custkey AS id, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 400000 ORDER BY o_orderkey, id"),
    "join_full": ("customer supplier", "SELECT c_custkey, s_suppkey AS id FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey + 5 ORDER BY c_custkey, id"),
    "join_cross": ("nation region", "SELECT n_name, r_name AS id FROM nation CROSS JOIN region ORDER BY n_name, id"),
    "join_comma": ("nation region", "SELECT n_name AS id, r_name FROM nation, region WHERE n_regionkey = r_regionkey ORDER BY id"),
    "join_using": ("customer", "SELECT a.c_name AS id, b.c_acctbal FROM customer a JOIN customer b USING (c_custkey) ORDER BY id"),
    "join_theta": ("nation region", "SELECT n_nationkey, r_regionkey AS id FROM nation JOIN region ON n_nationkey < r_regionkey ORDER BY n_nationkey, id"),
    "join_semi": ("customer orders", "SELECT c_custkey AS id FROM customer SEMI JOIN orders ON c_custkey = o_custkey ORDER BY id"),
    "join_anti": ("customer orders", "SELECT c_custkey AS id FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 ORDER BY id"),
    "join_self": ("nation", "SELECT a.n_name AS left_name, b.n_name AS id FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey ORDER BY left_name, id"),
    "join_multi": ("customer nation region orders", "SELECT r_name AS id, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name ORDER BY id"),
    "join_derived": ("customer orders", "SELECT t.k AS id, c_name, t.n FROM (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) AS t JOIN customer ON c_custkey = t.k ORDER BY id"),
    "agg_group": ("lineitem", "SELECT l_returnflag, l_linestatus AS id, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS qty, ROUND(AVG(l_discount), 8) AS disc, MIN(l_shipdate) IS NULL AS dateless FROM lineitem GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, id"),
    "agg_having": ("orders", "SELECT o_custkey AS id, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND SUM(o_totalprice) > 1000 ORDER BY id"),
    "agg_distinct": ("orders", "SELECT o_orderstatus AS id, COUNT(DISTINCT o_custkey) AS customers, ROUND(AVG(DISTINCT o_custkey), 6) AS mean FROM orders GROUP BY o_orderstatus ORDER BY id"),
    "agg_global": ("lineitem", "SELECT COUNT(*) AS n, COUNT(l_tax) AS taxed, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, MAX(l_quantity) AS top FROM lineitem"),
    "agg_minmax_str": ("part", "SELECT p_brand AS id, MIN(p_name) AS first_name, MAX(p_type) AS last_type FROM part GROUP BY p_brand ORDER BY id"),
    "dsl_aggregate": ("events", "SELECT event_type AS id, COUNT(*) AS n, ROUND(SUM(value), 4) AS total, MIN(value) AS low, MAX(value) AS high FROM events GROUP BY event_type ORDER BY id"),
    "union_distinct": ("customer supplier", "SELECT c_nationkey AS id FROM customer UNION SELECT s_nationkey AS id FROM supplier ORDER BY id"),
    "union_all": ("customer supplier", "SELECT c_nationkey AS id FROM customer UNION ALL SELECT s_nationkey AS id FROM supplier ORDER BY id"),
    "except_distinct": ("customer supplier", "SELECT c_nationkey AS id FROM customer EXCEPT SELECT s_nationkey AS id FROM supplier WHERE s_nationkey > 10 ORDER BY id"),
    "except_all": ("customer supplier", "SELECT c_nationkey AS id FROM customer EXCEPT ALL SELECT s_nationkey AS id FROM supplier ORDER BY id"),
    "intersect_distinct": ("customer supplier", "SELECT c_nationkey AS id FROM customer INTERSECT SELECT s_nationkey AS id FROM supplier ORDER BY id"),
    "intersect_all": ("customer supplier", "SELECT c_nationkey AS id FROM customer INTERSECT ALL SELECT s_nationkey AS id FROM supplier ORDER BY id"),
    "distinct": ("events", "SELECT DISTINCT event_type AS id FROM events ORDER BY id"),
    "order_nulls": ("customer orders", "SELECT c_custkey AS id, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 490000 ORDER BY o_orderkey DESC, id LIMIT 40"),
    "limit_offset": ("orders", "SELECT o_orderkey AS id, o_totalprice FROM orders ORDER BY o_totalprice DESC, id LIMIT 20 OFFSET 5"),
    "scalar_math": ("orders", "SELECT o_orderkey AS id, ABS(o_totalprice - 100000) AS a, CEIL(o_totalprice) AS c, FLOOR(o_totalprice) AS f, ROUND(o_totalprice, 1) AS r, o_custkey // 7 AS d, o_custkey ** 2 AS sq FROM orders ORDER BY id"),
    "scalar_case": ("customer", "SELECT c_custkey AS id, LOWER(c_name) AS low, UPPER(c_mktsegment) AS up, LENGTH(c_name) AS n, CHAR_LENGTH(c_mktsegment) AS m FROM customer ORDER BY id"),
    "scalar_trim": ("customer", "SELECT c_custkey AS id, TRIM('  ' || c_name || ' ') AS t, LTRIM(c_name, 'Cus') AS l, RTRIM(c_name, '0123') AS r, TRIM(c_mktsegment, 'AEB') AS b FROM customer ORDER BY id"),
    "scalar_match": ("part", "SELECT p_partkey AS id, CONTAINS(p_name, 'a') AS c, STARTS_WITH(p_type, 'S') AS s, ENDS_WITH(p_type, 'L') AS e FROM part ORDER BY id"),
    "scalar_concat": ("customer", "SELECT c_custkey AS id, CONCAT('a', NULL, c_mktsegment) AS c, CONCAT_WS('-', c_name, NULL, c_mktsegment) AS w, c_name || '!' AS p FROM customer ORDER BY id"),
    "scalar_sharp_s": ("customer", "SELECT c_custkey AS id, UPPER(c_name || 'straße é') AS u, LOWER(c_name || 'STRAẞE É') AS l FROM customer ORDER BY id"),
    "scalar_double_text": ("orders", "SELECT o_orderkey AS id, CAST(o_totalprice AS VARCHAR) AS plain, CAST(o_custkey * 1e17 AS VARCHAR) AS large, CAST(o_custkey / 100000000 AS VARCHAR) AS small, CAST(CAST(o_custkey AS DOUBLE) * 100000 AS TEXT) AS longer, CAST(o_custkey AS VARCHAR) AS whole, CAST(CAST(o_custkey AS DOUBLE) / 10000000 AS VARCHAR) AS near FROM orders ORDER BY id"),
    "sql_unsigned": ("orders", "SELECT o_orderkey AS id, CAST(o_custkey AS UINTEGER) AS u, TRY_CAST(o_custkey - 100 AS UTINYINT) AS b, TRY_CAST(o_totalprice AS USMALLINT) AS s FROM orders ORDER BY id"),
    "sql_distinct_on_text": ("orders", "SELECT DISTINCT ON (o_custkey) o_custkey, o_totalprice, o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_custkey, o_totalprice DESC, id"),
    "scalar_nulls": ("orders", "SELECT o_orderkey AS id, COALESCE(NULLIF(o_orderstatus, 'F'), 'was F') AS s, IFNULL(NULLIF(o_custkey, 1), -1) AS k FROM orders ORDER BY id"),
    "scalar_extremes": ("orders", "SELECT o_orderkey AS id, GREATEST(o_totalprice, 150000, NULL) AS g, LEAST(o_custkey, 40) AS l FROM orders ORDER BY id"),
}


def _sql(name: str):
    tables, query = SQL[name]
    return lambda spark, d: transform(spark, query, {t: _read(spark, d, t) for t in tables.split()}, None if name in ("agg_global",) else "id")


def _read(spark: SparkSession, d: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{t}.parquet")


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


# ---- bounded SQL beyond one text ----


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000.5")
def sql_params(spark, d):
    return transform(spark, "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = ? AND o_totalprice > ? ORDER BY id", {"orders": _read(spark, d, "orders")}, "id", ["F", 200000.5])


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) k FROM orders) WHERE k = 1")
def sql_distinct_on(spark, d):
    return distinct_on(_read(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT event_type, count(event_id) AS n, max(value) AS top FROM events WHERE value > 1 GROUP BY event_type")
def dsl_task(spark, d):
    from tributary.plans.dsl import run_task

    return run_task(spark, f"from '{d}/events.parquet' format parquet source-id-field event_id prepare filter value > 1 aggregate by event_type n=count(event_id), top=max(value) export").select("event_type", "n", "top")


@query("SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') || ' +00:00' AS o_orderdate FROM orders")
def source_parquet_text(spark, d):
    from tributary.sources.readers import read_files

    return read_files(spark, f"{d}/orders.parquet", "parquet").select("o_orderkey", "o_orderstatus", "o_orderdate")


# ---- recipes ----


def _recipe(spark, d, table, steps, order):
    return recipe.apply_recipe(_read(spark, d, table), steps, order)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'P'")
def recipe_filter(spark, d):
    return _recipe(spark, d, "orders", [{"op": "filter", "field": "o_totalprice", "predicate": "gte", "value": 100000}, {"op": "filter", "field": "o_orderstatus", "predicate": "ne", "value": "P"}, {"op": "select", "fields": ["o_orderkey", "o_totalprice"]}], ["o_orderkey"])


@query("SELECT c_custkey, c_name FROM customer")
def recipe_select(spark, d):
    return _recipe(spark, d, "customer", [{"op": "select", "fields": ["c_custkey", "c_name"]}], ["c_custkey"])


@query("SELECT c_custkey AS id, c_name AS name FROM customer")
def recipe_rename(spark, d):
    return _recipe(spark, d, "customer", [{"op": "rename", "from": "c_custkey", "to": "id"}, {"op": "rename", "from": "c_name", "to": "name"}, {"op": "select", "fields": ["id", "name"]}], ["c_custkey"])


@query("SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events")
def recipe_cast(spark, d):
    events = _read(spark, d, "events").select("event_id", F.regexp_extract("props", "[0-9]+", 0).alias("k"))
    return recipe.apply_recipe(events, [{"op": "cast", "field": "k", "to": "integer"}], ["event_id"])


@query("SELECT c_custkey, trim('  ' || c_name || chr(9), ' ' || chr(9)) AS c_name, lower(c_mktsegment) AS c_mktsegment FROM customer")
def recipe_trim_case(spark, d):
    rows = _read(spark, d, "customer").select("c_custkey", F.concat(F.lit("  "), "c_name", F.lit("\t")).alias("c_name"), "c_mktsegment")
    return recipe.apply_recipe(rows, [{"op": "trim", "field": "c_name"}, {"op": "case", "field": "c_mktsegment", "mode": "lower"}], ["c_custkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'final' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def recipe_replace(spark, d):
    return _recipe(spark, d, "orders", [{"op": "replace", "field": "o_orderstatus", "from": "F", "to": "final"}, {"op": "select", "fields": ["o_orderkey", "o_orderstatus"]}], ["o_orderkey"])


_HOLES = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS p FROM orders"


def _holes(spark, d):
    k = F.col("o_orderkey")
    return _read(spark, d, "orders").select("o_orderkey", F.when(k % 5 == 0, "").when(k % 7 == 0, None).otherwise(F.col("o_orderstatus")).alias("s"), F.when(k % 3 != 0, F.col("o_totalprice")).alias("p"))


@query(f"SELECT o_orderkey, CASE WHEN s IS NULL OR s = '' THEN 'none' ELSE s END AS s, coalesce(p, 0.0) AS p FROM ({_HOLES})")
def recipe_fill(spark, d):
    return recipe.apply_recipe(_holes(spark, d), [{"op": "fill", "field": "s", "value": "none"}, {"op": "fill", "field": "p", "value": 0.0}], ["o_orderkey"])


@query(f"SELECT * FROM ({_HOLES}) WHERE NOT (s IS NULL OR s = '' OR p IS NULL)")
def recipe_drop_any(spark, d):
    return recipe.apply_recipe(_holes(spark, d), [{"op": "drop_missing", "fields": ["s", "p"], "mode": "any"}], ["o_orderkey"])


@query(f"SELECT * FROM ({_HOLES}) WHERE NOT ((s IS NULL OR s = '') AND p IS NULL)")
def recipe_drop_all(spark, d):
    return recipe.apply_recipe(_holes(spark, d), [{"op": "drop_missing", "fields": ["s", "p"], "mode": "all"}], ["o_orderkey"])


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) k FROM events) WHERE k = 1")
def recipe_dedupe_first(spark, d):
    return _recipe(spark, d, "events", [{"op": "dedupe", "by": ["user_id", "event_type"], "keep": "first"}, {"op": "select", "fields": ["event_id", "user_id", "event_type"]}], ["event_id"])


_PIPE = [{"op": "filter", "field": "value", "predicate": "gt", "value": 1}, {"op": "dedupe", "by": ["user_id"]}, {"op": "case", "field": "event_type", "mode": "upper"}, {"op": "select", "fields": ["event_id", "user_id", "event_type"]}]


@query("SELECT event_id, user_id, upper(event_type) AS event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) k FROM events WHERE value > 1) WHERE k = 1")
def recipe_pipeline(spark, d):
    return _recipe(spark, d, "events", _PIPE, ["event_id"])


@query("SELECT count(*) AS source_rows, (SELECT count(DISTINCT user_id) FROM events WHERE value > 1) AS output_rows, count(*) FILTER (NOT value > 1) AS filtered_rows, count(*) FILTER (value > 1) - (SELECT count(DISTINCT user_id) FROM events WHERE value > 1) AS duplicate_rows FROM events")
def recipe_counters(spark, d):
    return recipe.counters(_read(spark, d, "events"), _PIPE, ["event_id"])


@query("SELECT count(*) AS n, count(*) AS ids FROM lineitem")
def recipe_generated_id(spark, d):
    from tributary.sources.readers import with_row_id

    rows = with_row_id(_read(spark, d, "lineitem"), "row_id")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("ids"))


# ---- records ----

_AFTER = "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 97 <> 0 UNION ALL SELECT -o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 101 = 0 AND o_orderkey > 0"
_DIFF = f"SELECT CAST(coalesce(a.o_orderkey, b.o_orderkey) AS VARCHAR) AS rid, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_totalprice <> b.o_totalprice THEN 'modified' ELSE 'unchanged' END AS change FROM orders a FULL JOIN ({_AFTER}) b ON a.o_orderkey = b.o_orderkey"


def _versions(spark, d):
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    k = F.col("o_orderkey")
    a = _read(spark, d, "orders").select(*names)
    b = a.where(k % 97 != 0).withColumn("o_totalprice", F.when(k % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return a, b.unionByName(a.where((k % 101 == 0) & (k > 0)).withColumn("o_orderkey", -k))


@query("SELECT * FROM (SELECT 's' AS field, 'string' AS kind, count(s) AS present, count(*) - count(s) AS nulls, count(*) FILTER (s = '') AS empty_strings FROM (%s) UNION ALL SELECT 'p', 'number', count(p), count(*) - count(p), 0 FROM (%s) UNION ALL SELECT 'o_orderkey', 'number', count(o_orderkey), 0, 0 FROM (%s))" % (_HOLES, _HOLES, _HOLES))
def profile_fields(spark, d):
    return records.profile_fields(_holes(spark, d))


@query("SELECT count(*) AS records, count(*) - count(k) AS null_ids, count(*) FILTER (trim(k) = '') AS blank_ids, count(*) FILTER (trim(k) <> '') - count(DISTINCT k) FILTER (trim(k) <> '') AS duplicate_ids FROM (SELECT CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 13 = 0 THEN ' ' ELSE CAST(l_orderkey AS VARCHAR) END AS k FROM lineitem)")
def id_health(spark, d):
    k = F.col("l_orderkey")
    return records.id_health(_read(spark, d, "lineitem").select(F.when(k % 11 == 0, None).when(k % 13 == 0, " ").otherwise(k.cast("string")).alias("k")), "k")


@query("SELECT o_orderkey, row_number() OVER () - 1 AS row FROM orders")
def source_row_numbers(spark, d):
    """Numbers of rows in their file, from which generated ids are made."""
    return readers.with_ordinals(_read(spark, d, "orders").select("o_orderkey")).select("o_orderkey", F.col("_row").alias("row"))


@query(_DIFF)
def record_diff_rows(spark, d):
    return records.diff(*_versions(spark, d), "o_orderkey")


@query(f"SELECT change, count(*) AS n FROM ({_DIFF}) GROUP BY change")
def record_diff_summary(spark, d):
    return records.diff(*_versions(spark, d), "o_orderkey").groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT rid FROM ({_DIFF}) WHERE change IN ('added', 'modified')")
def changed_records(spark, d):
    return records.changed(*_versions(spark, d), "o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey = 7 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def field_patch(spark, d):
    rows = _read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    seen = rows.where("o_orderkey = 7").first()
    return records.patch(rows, "o_orderkey", "7", "o_orderstatus", seen["o_orderstatus"] if seen else None, "X")


@query("SELECT o_orderkey, 's' || o_orderstatus AS status_key FROM orders")
def scalar_keys(spark, d):
    return _read(spark, d, "orders").select("o_orderkey", typed_key(F.col("o_orderstatus"), "string").alias("status_key"))


# ---- field rules ----

_RULES = {"event_type": {"type": "string", "enum": ["click", "view"]}, "value": {"type": "number", "min": 0.5, "max": 100, "nullable": False}, "props": {"type": "string", "pattern": "[0-4]}"}, "user_id": {"unique": True}, "absent": {"required": True}, "ts": {"type": "string"}}
_BROKEN = """SELECT * FROM (
  SELECT CAST(event_id AS VARCHAR) AS rid, 'event_type' AS field, 'ENUM' AS code FROM events WHERE event_type NOT IN ('click', 'view')
  UNION ALL SELECT CAST(event_id AS VARCHAR), 'value', 'NULL' FROM events WHERE value IS NULL
  UNION ALL SELECT CAST(event_id AS VARCHAR), 'value', 'RANGE' FROM events WHERE value < 0.5 OR value > 100
  UNION ALL SELECT CAST(event_id AS VARCHAR), 'props', 'PATTERN' FROM events WHERE NOT regexp_matches(props, '[0-4]}')
  UNION ALL SELECT CAST(event_id AS VARCHAR), 'user_id', 'UNIQUE' FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) > 1)
  UNION ALL SELECT CAST(event_id AS VARCHAR), 'absent', 'REQUIRED' FROM events
  UNION ALL SELECT CAST(event_id AS VARCHAR), 'ts', 'TYPE' FROM events WHERE ts IS NOT NULL)"""
#: A violation gates where its record changed; one of uniqueness, where any member of its group of equal values did.
_CHANGED = "CASE WHEN code = 'UNIQUE' THEN rid IN (SELECT CAST(event_id AS VARCHAR) FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_id % 50 = 3)) ELSE CAST(rid AS BIGINT) % 50 = 3 END"
_ROLLED = "SELECT field, code, count(*) AS total, count(*) FILTER (g) AS gated, array_to_string(list_slice(list_sort(list(DISTINCT rid) FILTER (g)), 1, 20), ',') AS samples, count(*) FILTER (g) > 20 AS truncated FROM (SELECT *, {gate} AS g FROM ({rows})) GROUP BY field, code HAVING count(*) FILTER (g) > 0"


def _rolled(found):
    return found.select("field", "code", "total", "gated", F.array_join("sample_ids", ",").alias("samples"), "truncated")


@query(_ROLLED.format(gate="true", rows=_BROKEN))
def policy_rollup_full(spark, d):
    return _rolled(policy.evaluate(_read(spark, d, "events"), "event_id", _RULES))


@query(_ROLLED.format(gate=_CHANGED, rows=_BROKEN))
def policy_changed_only(spark, d):
    events = _read(spark, d, "events")
    changed = events.where("event_id % 50 = 3").select(F.col("event_id").cast("string").alias("rid"))
    return _rolled(policy.evaluate(events, "event_id", _RULES, changed))


@query(f"SELECT 'JSONL_POLICY_' || code AS code, rid, CAST(rid AS BIGINT) * 2 AS line FROM (SELECT code, unnest(list_slice(list_sort(list(DISTINCT rid)), 1, 20)) AS rid FROM ({_BROKEN}) GROUP BY field, code)")
def locate(spark, d):
    events = _read(spark, d, "events")
    found = inspect.quality_findings(policy.evaluate(events, "event_id", _RULES)).withColumn("finding_id", F.col("code"))
    return records.locate(found, records.index(events.withColumn("line", F.col("event_id") * 2), "event_id", "line")).select(F.col("finding_id").alias("code"), "rid", "line")


# ---- views and exports ----


def _slot_sql(domain: str, seed: str, rid: str) -> str:
    return f"(CAST('0x' || substr(sha256('{domain}:{len(seed)}:{seed}:' || CAST({rid} AS VARCHAR)), 1, 12) AS BIGINT) * 10000) >> 48"


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 50000 AND o_totalprice < 200000")
def view_predicates(spark, d):
    rows = views.subset(_read(spark, d, "orders"), [("o_orderstatus", "in", ["F", "O", 3]), ("o_totalprice", "gte", 50000), ("o_totalprice", "lt", 200000), ("o_custkey", "exists"), ("nothing", "missing")])
    return rows.select("o_orderkey")


@query(f"SELECT o_orderkey FROM orders WHERE {_slot_sql('sample', 'pick', 'o_orderkey')} < 1500")
def view_sample(spark, d):
    return views.sample(_read(spark, d, "orders"), "o_orderkey", "pick", 1500).select("o_orderkey")


_WEIGHTS = {"train": 80, "val": 10, "test": 10}
_SPLIT = f"SELECT o_orderkey, sha256('split:4:seed:' || CAST(o_orderkey AS VARCHAR)) AS split_key, {_slot_sql('split', 'seed', 'o_orderkey')} AS slot FROM orders"
_SPLITS = f"SELECT *, CASE WHEN slot < 1000 THEN 'test' WHEN slot < 9000 THEN 'train' ELSE 'val' END AS split FROM ({_SPLIT})"
_RANKED = f"SELECT *, row_number() OVER (PARTITION BY split ORDER BY split_key, o_orderkey) - 1 AS position FROM ({_SPLITS})"


def _assigned(spark, d):
    return export.assign(_read(spark, d, "orders").select("o_orderkey"), "o_orderkey", "seed", _WEIGHTS)


@query(f"SELECT o_orderkey, CAST(slot AS INTEGER) AS slot, split FROM ({_SPLITS})")
def split_assign(spark, d):
    return _assigned(spark, d).select("o_orderkey", "slot", "split")


@query(f"SELECT split, count(*) AS n FROM ({_SPLITS}) GROUP BY split")
def split_counts(spark, d):
    return _assigned(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT o_orderkey, split, position, position // 500 AS shard FROM ({_RANKED})")
def shard_assign_records(spark, d):
    return export.shard(_assigned(spark, d), "o_orderkey", 500).select("o_orderkey", "split", F.col("position").cast("long").alias("position"), "shard")


@query(f"SELECT split, count(*) AS records, count(DISTINCT position // 500) AS shards FROM ({_RANKED}) GROUP BY split")
def shard_summary(spark, d):
    return export.summary(export.shard(_assigned(spark, d), "o_orderkey", 500))


_SIZED = f"SELECT split, o_orderkey AS id, position, 20 + o_orderkey % 30 AS bytes, sum(20 + o_orderkey % 30) OVER (PARTITION BY split ORDER BY position) AS upto FROM ({_RANKED})"


@query(f"""WITH RECURSIVE x AS MATERIALIZED ({_SIZED}), s AS (SELECT split, CAST(0 AS BIGINT) AS shard, CAST(0 AS BIGINT) AS begins FROM x WHERE position = 0
  UNION ALL SELECT s.split, s.shard + 1, CAST(min(p.position) AS BIGINT) FROM s JOIN x f ON f.split = s.split AND f.position = s.begins
    JOIN x p ON p.split = s.split AND p.position > s.begins AND (p.position - s.begins >= 400 OR p.upto - (f.upto - f.bytes) > 8000) GROUP BY s.split, s.shard)
  SELECT x.split, x.id, x.position, s.shard FROM x ASOF JOIN s ON x.split = s.split AND x.position >= s.begins""")
def shard_assign_bytes(spark, d):
    rows = _assigned(spark, d).withColumn("bytes", 20 + F.col("o_orderkey") % 30)
    return export.shard_by_bytes(rows, "o_orderkey", 400, 8000)


@query("SELECT 0 AS wrong_split, 0 AS wrong_order, 0 AS repeated")
def export_verify(spark, d):
    return export.verify(export.shard(_assigned(spark, d), "o_orderkey", 500), "o_orderkey", "seed", _WEIGHTS, 500)


@query(f"SELECT (SELECT count(*) + count(*) FILTER (o_orderkey % 97 = 0) FROM ({_SPLITS}) WHERE o_orderkey % 101 = 0 AND split <> 'val') AS wrong_split, 0 AS wrong_order, (SELECT count(*) FROM orders WHERE o_orderkey % 97 = 0) AS repeated")
def export_verify_spoiled(spark, d):
    rows = _assigned(spark, d).withColumn("split", F.when(F.col("o_orderkey") % 101 == 0, "val").otherwise(F.col("split")))
    rows = export.shard(rows, "o_orderkey", 500)
    return export.verify(rows.union(rows.where("o_orderkey % 97 = 0")), "o_orderkey", "seed", _WEIGHTS, 500)


# ---- reviews: documents as samples, their language as label and their source as split ----

_SAMPLES = "SELECT 'd/' || CAST(doc_id AS VARCHAR) AS path, sha256(text) AS content_hash, lang AS label, source AS split, length(text) AS size FROM documents"
_LATER = "SELECT CASE WHEN doc_id % 17 = 0 THEN 'm/' || CAST(doc_id AS VARCHAR) ELSE 'd/' || CAST(doc_id AS VARCHAR) END AS path, CASE WHEN doc_id % 19 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS content_hash, CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS label, source AS split, length(text) AS size FROM documents WHERE doc_id % 23 <> 0"


def _samples(spark, d):
    docs, k = _read(spark, d, "documents"), F.col("doc_id")
    name = k.cast("string")
    a = docs.select(F.concat(F.lit("d/"), name).alias("path"), F.sha2("text", 256).alias("content_hash"), F.col("lang").alias("label"), F.col("source").alias("split"), F.length("text").cast("long").alias("size"))
    b = docs.where(k % 23 != 0).select(
        F.concat(F.when(k % 17 == 0, "m/").otherwise("d/"), name).alias("path"), F.sha2(F.concat("text", F.when(k % 19 == 0, "!").otherwise("")), 256).alias("content_hash"),
        F.when(k % 5 == 0, "xx").otherwise(F.col("lang")).alias("label"), F.col("source").alias("split"), F.length("text").cast("long").alias("size"),
    )
    return a, b


@query(f"SELECT a.path AS before_path, b.path AS after_path, CASE WHEN a.content_hash = b.content_hash THEN 'exact' ELSE 'probable' END AS confidence FROM ({_SAMPLES}) a JOIN ({_LATER}) b ON a.path = b.path")
def match_path(spark, d):
    return review.match_paths(*_samples(spark, d))


_GONE = f"SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS k FROM ({_SAMPLES}) WHERE path NOT IN (SELECT path FROM ({_LATER}))"
_COME = f"SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS k FROM ({_LATER}) WHERE path NOT IN (SELECT path FROM ({_SAMPLES}))"


@query(f"SELECT a.path AS before_path, b.path AS after_path FROM ({_GONE}) a JOIN ({_COME}) b ON a.content_hash = b.content_hash AND a.k = b.k")
def match_content(spark, d):
    return review.match_contents(*_samples(spark, d))


_MATCHED = f"SELECT a.path AS before_path, b.path AS after_path FROM ({_SAMPLES}) a JOIN ({_LATER}) b ON a.path = b.path UNION ALL SELECT a.path, b.path FROM ({_GONE}) a JOIN ({_COME}) b ON a.content_hash = b.content_hash AND a.k = b.k"


@query(f"""SELECT a.path AS before_path, b.path AS after_path, unnest(list_filter([CASE WHEN a.path IS NULL THEN 'SAMPLE_ADDED' END, CASE WHEN b.path IS NULL THEN 'SAMPLE_REMOVED' END,
  CASE WHEN m.after_path IS NOT NULL AND a.split IS DISTINCT FROM b.split THEN 'SPLIT_CHANGED' END, CASE WHEN m.after_path IS NOT NULL AND a.label IS DISTINCT FROM b.label THEN 'LABEL_CHANGED' END,
  CASE WHEN a.path <> b.path THEN 'SAMPLE_MOVED' END, CASE WHEN a.content_hash <> b.content_hash THEN 'CONTENT_CHANGED' END], lambda x: x IS NOT NULL)) AS code
  FROM ({_SAMPLES}) a FULL JOIN ({_MATCHED}) m ON a.path = m.before_path FULL JOIN ({_LATER}) b ON m.after_path = b.path""")
def sample_changes(spark, d):
    return review.changes(*_samples(spark, d))


@query(None)
def sample_findings(spark, d):
    return review.sample_findings(*_samples(spark, d))


@query(None)
def near_duplicate_groups(spark, d):
    return review.near_groups(_signs(spark, d), 17)


_GROUPS = f"SELECT content_hash, count(*) AS members, count(DISTINCT split) AS splits FROM ({_SAMPLES}) GROUP BY content_hash HAVING count(*) > 1"


@query(f"SELECT *, 'EXACT_DUPLICATE_GROUP' AS code FROM ({_GROUPS}) UNION ALL SELECT *, 'CROSS_SPLIT_EXACT_LEAKAGE' FROM ({_GROUPS}) WHERE splits > 1")
def exact_duplicates(spark, d):
    return review.exact_groups(_samples(spark, d)[0])


_BITS = "SELECT vec_id AS id, label, list_sum(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i] > 0 THEN CAST(1 AS BIGINT) << CAST(i - 1 AS BIGINT) ELSE 0 END)) AS bits FROM embeddings"


def _signs(spark, d):
    bit = lambda i: F.when(F.col("embedding")[i] > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    total = bit(0)
    for i in range(1, 63):
        total = total + bit(i)
    return _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("split"), total.alias("bits"), F.sha2(F.col("vec_id").cast("string"), 256).alias("content_hash"))


_PAIRS = f"SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(CAST(a.bits AS BIGINT), CAST(b.bits AS BIGINT))) AS BIGINT) AS distance FROM ({_BITS}) a JOIN ({_BITS}) b ON a.id < b.id AND bit_count(xor(CAST(a.bits AS BIGINT), CAST(b.bits AS BIGINT))) <= 17"


@query(_PAIRS)
def near_duplicate_pairs(spark, d):
    signs = _signs(spark, d)
    return review.near_pairs(signs, signs, 17).where("a < b")


@query(f"WITH RECURSIVE e AS (SELECT a, b FROM ({_PAIRS}) UNION SELECT b, a FROM ({_PAIRS})), r AS (SELECT DISTINCT a AS n, a AS m FROM e UNION SELECT r.n, e.b FROM r JOIN e ON e.a = r.m) SELECT n AS id, min(m) AS component FROM r GROUP BY n")
def near_duplicate_components(spark, d):
    return review.near_components(_signs(spark, d), 17)


def _pairs_of(radius: int) -> str:
    apart = "bit_count(xor(CAST(a.bits AS BIGINT), CAST(b.bits AS BIGINT)))"
    return f"SELECT a.id AS a, b.id AS b, CAST({apart} AS BIGINT) AS distance FROM ({_BITS}) a JOIN ({_BITS}) b ON a.id % 2 = 0 AND b.id % 2 = 1 AND {apart} <= {radius}"


#: Codes of six bits kept of each vector, the rest filled in from its number: many are close at the default radius.
_CLOSE = "SELECT vec_id AS id, (vec_id % 64) * 1048576 + CASE WHEN embedding[1] > 0 THEN 1099511627776 ELSE 0 END + CASE WHEN embedding[2] > 0 THEN 1125899906842624 ELSE 0 END + CASE WHEN embedding[3] > 0 THEN 63 ELSE 0 END AS bits FROM embeddings"


@query(f"SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.bits, b.bits)) AS BIGINT) AS distance FROM ({_CLOSE}) a JOIN ({_CLOSE}) b ON a.id < b.id AND bit_count(xor(a.bits, b.bits)) <= 6")
def near_duplicate_pairs_default(spark, d):
    v, e = F.col("vec_id"), F.col("embedding")
    sign = lambda k, x: F.when(e[k] > 0, F.lit(x)).otherwise(F.lit(0)).cast("long")
    codes = _read(spark, d, "embeddings").select(v.alias("id"), (F.shiftleft(v % 64, 20).bitwiseOR(sign(0, 1 << 40)).bitwiseOR(sign(1, 1 << 50)).bitwiseOR(sign(2, 63))).alias("bits"))
    return review.near_pairs(codes, codes).where("a < b")


@query(f"""WITH RECURSIVE r AS (SELECT a, b, distance, false AS chosen FROM ({_pairs_of(19)}) UNION ALL SELECT a, b, distance, c FROM (
  SELECT *, bool_or(c) OVER (PARTITION BY a) AS ka, bool_or(c) OVER (PARTITION BY b) AS kb FROM (
    SELECT a, b, distance, row_number() OVER (PARTITION BY a ORDER BY distance, a, b) = 1 AND row_number() OVER (PARTITION BY b ORDER BY distance, a, b) = 1 AS c FROM r WHERE NOT chosen)) WHERE c OR NOT (ka OR kb))
  SELECT a, b, distance FROM r WHERE chosen""")
def match_greedy(spark, d):
    signs = _signs(spark, d)
    return review.greedy_match(review.near_pairs(signs.where("id % 2 = 0"), signs.where("id % 2 = 1"), 19))


@query(None)
def match_optimal(spark, d):
    signs = _signs(spark, d)
    return review.optimal_match(review.near_pairs(signs.where("id % 2 = 0"), signs.where("id % 2 = 1"), 17))


_CELLS = "SELECT dimension, key, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY dimension) AS share FROM (SELECT unnest(['label', 'split']) AS dimension, unnest([label, split]) AS key FROM ({rows})) GROUP BY dimension, key"


@query("SELECT dimension, key, n, round(share, 9) AS share FROM (%s)" % _CELLS.format(rows=_SAMPLES))
def distribution(spark, d):
    return review.distribution(_samples(spark, d)[0], ("label", "split")).select("dimension", "key", "n", F.round("share", 9).alias("share"))


_DRIFT = f"SELECT coalesce(a.dimension, b.dimension) AS dimension, coalesce(a.key, b.key) AS key, coalesce(a.n, 0) AS before_n, coalesce(b.n, 0) AS after_n, coalesce(b.share, 0) - coalesce(a.share, 0) AS moved FROM ({_CELLS.format(rows=_SAMPLES)}) a FULL JOIN ({_CELLS.format(rows=_LATER)}) b ON a.dimension = b.dimension AND a.key = b.key"


@query(f"SELECT dimension, key, before_n, after_n, round(moved, 9) AS share_change FROM ({_DRIFT})")
def distribution_delta(spark, d):
    return review.drift(*_samples(spark, d), ("label", "split")).select("dimension", "key", "before_n", "after_n", F.round("share_change", 9).alias("share_change"))


@query(f"SELECT CASE WHEN dimension = 'label' THEN 'LABEL_DISTRIBUTION_CHANGED' ELSE 'MEDIA_DISTRIBUTION_CHANGED' END AS code, dimension, key FROM ({_DRIFT}) WHERE abs(moved) >= 0.1")
def distribution_findings(spark, d):
    return review.drift_findings(review.drift(*_samples(spark, d), ("label", "split"))).select("code", "dimension", "key")


@query(f"SELECT CASE WHEN count(*) FILTER (splits > 1) > 0 THEN 'fail' WHEN count(*) > 0 THEN 'warn' ELSE 'pass' END AS status FROM ({_GROUPS})")
def severity_status(spark, d):
    return review.status(exact_duplicates(spark, d))


_G2, _C2 = (x.replace("PARTITION BY content_hash ORDER", "PARTITION BY content_hash, size ORDER") for x in (_GONE, _COME))


@query(f"SELECT b.path, NULL::VARCHAR AS old_path, CASE WHEN a.content_hash = b.content_hash THEN 'unchanged' ELSE 'modified' END AS change FROM ({_SAMPLES}) a JOIN ({_LATER}) b ON a.path = b.path UNION ALL SELECT coalesce(b.path, a.path), CASE WHEN b.path IS NOT NULL THEN a.path END, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'renamed' END FROM ({_G2}) a FULL JOIN ({_C2}) b ON a.content_hash = b.content_hash AND a.size = b.size AND a.k = b.k")
def manifest_changes(spark, d):
    keep = ("path", "size", "content_hash")
    a, b = _samples(spark, d)
    return review.manifest_diff(a.select(*keep), b.select(*keep))


def _found(spark, d):
    groups = exact_duplicates(spark, d)
    return groups.select(F.when(F.col("code") == "CROSS_SPLIT_EXACT_LEAKAGE", "error").otherwise("warning").alias("severity"), "code", F.col("content_hash").alias("message"), F.array("content_hash").alias("sample_ids"))


_FOUND = f"SELECT 'warning' AS severity, 'EXACT_DUPLICATE_GROUP' AS code, content_hash AS message FROM ({_GROUPS}) UNION ALL SELECT 'error', 'CROSS_SPLIT_EXACT_LEAKAGE', content_hash FROM ({_GROUPS}) WHERE splits > 1"


@query(f"SELECT severity, code, message FROM ({_FOUND}) ORDER BY CASE severity WHEN 'error' THEN 0 ELSE 1 END, code, message LIMIT 20 OFFSET 5")
def findings_page(spark, d):
    return findings.page(_found(spark, d), 5, 20).select("severity", "code", "message")


@query(f"SELECT severity, code, count(*) AS n FROM ({_FOUND}) GROUP BY severity, code")
def findings_summary(spark, d):
    return findings.summary(_found(spark, d))


@query(f"SELECT code, CASE code WHEN 'EXACT_DUPLICATE_GROUP' THEN 'dedupe' ELSE 'move' END AS action, 'high' AS risk, count(*) AS n FROM ({_FOUND}) GROUP BY code")
def remediation_plan(spark, d):
    return findings.remediation(_found(spark, d))


# ---- files written and read back, raw lines, documents ----


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/tributary/query-{uuid.uuid4().hex}"


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def sink_jsonl_round_trip(spark, d):
    target = _folder(spark)
    sinks.write_jsonl(_read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey", target)
    return readers.read_jsonl(spark, [target], same_keys=True).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT count(*) AS rows, CAST(sum(strlen('{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}') + 1) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS null_ids, CAST(0 AS BIGINT) AS repeated_ids, CAST(0 AS BIGINT) AS not_finite FROM orders")
def sink_output_facts(spark, d):
    return sinks.output_facts(_read(spark, d, "orders").select("o_orderstatus", "o_orderkey"), "o_orderkey").select("rows", "bytes", "null_ids", "repeated_ids", "not_finite")


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ', \"' || chr(10) || c_mktsegment || '\"' AS text, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'x' END AS hole FROM customer")
def source_csv_round_trip(spark, d):
    target = _folder(spark)
    rows = _read(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit(', "\n'), "c_mktsegment", F.lit('"')).alias("text"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise("x").alias("hole"))
    rows.repartition(3).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(target)
    return readers.read_csv(spark, [target])


_SHARDS = f"SELECT split, position // 500 AS shard, position % 500 AS line_no, o_orderkey FROM ({_RANKED})"


def _bundle(spark, d) -> str:
    target = _folder(spark)
    sinks.write_bundle(export.shard(_assigned(spark, d), "o_orderkey", 500), "o_orderkey", target)
    return target


@query(f"SELECT split, shard, count(*) AS records, CAST(sum(strlen('{{\"o_orderkey\":' || o_orderkey || '}}') + 1) AS BIGINT) AS bytes FROM ({_SHARDS}) GROUP BY split, shard")
def bundle_manifest(spark, d):
    return sinks.read_manifest(spark, _bundle(spark, d)).select("split", "shard", "records", "bytes")


@query(f"SELECT split, shard, CAST(line_no AS INTEGER) AS line_no, o_orderkey FROM ({_SHARDS})")
def bundle_records(spark, d):
    rows = sinks.read_shards(spark, _bundle(spark, d))
    return rows.select("split", "shard", "line_no", F.get_json_object("value", "$.o_orderkey").cast("bigint").alias("o_orderkey"))


@query("SELECT CAST(0 AS BIGINT) AS changed_files, CAST(0 AS BIGINT) AS wrong_split, CAST(0 AS BIGINT) AS wrong_order, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS oversize, CAST(0 AS BIGINT) AS miscounted")
def bundle_verify(spark, d):
    return sinks.verify_bundle(spark, _bundle(spark, d), "o_orderkey", "seed", _WEIGHTS, 500)


@query(f"SELECT split, shard FROM (SELECT DISTINCT split, shard FROM ({_SHARDS}) WHERE split = 'train') WHERE shard % 3 = 1")
def consumer_shards(spark, d):
    return sinks.worker_shards(sinks.read_manifest(spark, _bundle(spark, d)), "train", 1, 3).select("split", "shard")


#: Lines of all kinds, told by the number of an order: blank, broken, no object, no id, ids of odd types, repeated ids.
_KINDS = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 41 = 0 THEN 'blank' WHEN o_orderkey % 37 = 0 THEN 'broken' WHEN o_orderkey % 31 = 0 THEN 'list' WHEN o_orderkey % 29 = 0 THEN 'missing' WHEN o_orderkey % 23 = 0 THEN 'null' WHEN o_orderkey % 19 = 0 THEN 'odd' WHEN o_orderkey % 17 = 0 THEN 'twice' ELSE 'good' END AS kind FROM orders"


def _lines(spark, d):
    k = F.col("o_orderkey")
    name, target = k.cast("string"), _folder(spark)
    kind = F.when(k % 41 == 0, "  ").when(k % 37 == 0, F.concat(F.lit('{"id":'), name)).when(k % 31 == 0, F.concat(F.lit("["), name, F.lit("]"))).when(k % 29 == 0, F.concat(F.lit('{"other":'), name, F.lit("}")))
    kind = kind.when(k % 23 == 0, '{"id":null}').when(k % 19 == 0, '{"id":[1]}').when(k % 17 == 0, '{"id":"same","v":1.50}').otherwise(F.concat(F.lit('{"id":'), name, F.lit(',"v":null}')))
    _read(spark, d, "orders").select(kind.alias("value")).write.text(target)
    return inspect.parsed_lines(spark, [target], "id")


@query(f"""SELECT count(*) FILTER (kind NOT IN ('blank', 'broken', 'list')) AS records, count(*) FILTER (kind = 'blank') AS blank_lines, count(*) FILTER (kind IN ('broken', 'list')) AS invalid_records, count(*) FILTER (kind = 'missing') AS missing_ids,
  count(*) FILTER (kind = 'null') AS null_ids, count(*) FILTER (kind = 'odd') AS invalid_ids, count(*) FILTER (kind = 'twice') - 1 + count(*) FILTER (kind = 'good') - count(DISTINCT k) FILTER (kind = 'good') AS duplicate_ids FROM ({_KINDS})""")
def inspect_health(spark, d):
    return inspect.health(_lines(spark, d)).drop("findings")


@query(f"""SELECT 'id' AS field, count(*) FILTER (kind IN ('null', 'odd', 'twice', 'good')) AS present, count(*) FILTER (kind = 'null') AS nulls, 'array,null,number,string' AS kinds FROM ({_KINDS})
  UNION ALL SELECT 'v', count(*) FILTER (kind IN ('twice', 'good')), count(*) FILTER (kind = 'good'), 'null,number' FROM ({_KINDS}) UNION ALL SELECT 'other', count(*) FILTER (kind = 'missing'), 0, 'number' FROM ({_KINDS})""")
def inspect_fields(spark, d):
    return inspect.field_profile(_lines(spark, d))


@query(f"""SELECT 'JSONL_INVALID_RECORD' AS code, '{{"count":' || count(*) || '}}' AS evidence FROM ({_KINDS}) WHERE kind IN ('broken', 'list') UNION ALL SELECT 'JSONL_MISSING_ID', '{{"count":' || count(*) || '}}' FROM ({_KINDS}) WHERE kind = 'missing'
  UNION ALL SELECT 'JSONL_NULL_ID', '{{"count":' || count(*) || '}}' FROM ({_KINDS}) WHERE kind = 'null' UNION ALL SELECT 'JSONL_INVALID_ID', '{{"count":' || count(*) || '}}' FROM ({_KINDS}) WHERE kind = 'odd'
  UNION ALL SELECT 'JSONL_DUPLICATE_ID', '{{"count":' || (count(*) FILTER (kind = 'twice') - 1 + count(*) FILTER (kind = 'good') - count(DISTINCT k) FILTER (kind = 'good')) || '}}' FROM ({_KINDS})""")
def review_structure(spark, d):
    return inspect.structural_findings(inspect.health(_lines(spark, d))).select("code", "evidence")


@query(f"SELECT k AS id FROM ({_KINDS}) WHERE kind = 'good' AND k >= 100 AND k < 4000 AND k NOT IN (200, 300)")
def view_records(spark, d):
    found = views.subset_records(_lines(spark, d), [("id", "gte", 100), ("id", "lt", 4000), ("v", "exists"), ("v", "is_null"), ("other", "missing")])
    gone = views.subset_records(_lines(spark, d), [("id", "in", [200.0, 300, "400", None])])
    return found.join(gone.select("key"), "key", "left_anti").select(F.variant_get("value", "$.id", "long").alias("id"))


@query("SELECT count(*) AS records, CAST(0 AS BIGINT) AS missing_ids, count(*) - count(k) AS null_ids, CAST(0 AS BIGINT) AS invalid_ids, count(k) - count(DISTINCT k) AS duplicate_ids, count(*) - count(DISTINCT k) AS findings FROM (SELECT CASE WHEN l_orderkey % 11 <> 0 THEN l_orderkey END AS k FROM lineitem)")
def inspect_table(spark, d):
    return inspect.tabular_health(_read(spark, d, "lineitem").select(F.when(F.col("l_orderkey") % 11 != 0, F.col("l_orderkey")).alias("k")), "k")


@query(f"SELECT CASE change WHEN 'added' THEN 'RECORD_ADDED' WHEN 'removed' THEN 'RECORD_REMOVED' ELSE 'RECORD_MODIFIED' END AS code, 'info' AS severity, '{{\"count\":' || count(*) || '}}' AS evidence FROM ({_DIFF}) WHERE change <> 'unchanged' GROUP BY change UNION ALL SELECT 'JSONL_POLICY_RANGE', 'error', '{{\"field\":\"o_totalprice\",\"rule\":\"RANGE\",\"total_violations\":' || count(*) || ',\"gated_violations\":' || count(*) FILTER (CAST(o_orderkey AS VARCHAR) IN (SELECT rid FROM ({_DIFF}) WHERE change IN ('added', 'modified'))) || ',\"samples_truncated\":' || (count(*) FILTER (CAST(o_orderkey AS VARCHAR) IN (SELECT rid FROM ({_DIFF}) WHERE change IN ('added', 'modified'))) > 20) || '}}' FROM ({_AFTER}) WHERE o_totalprice > 100000")
def review_records(spark, d):
    before, after = _versions(spark, d)
    return inspect.review_records(before, after, "o_orderkey", {"o_totalprice": {"type": "number", "max": 100000}}, "changed_only").select("code", "severity", "evidence")


@query(f"SELECT count(*) FILTER (o_orderkey % 2 = 0) AS unchanged, count(*) FILTER (o_orderkey % 2 <> 0) AS moved FROM orders")
def record_diff_moved(spark, d):
    rows = _read(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderkey").alias("line"))
    later = rows.withColumn("line", F.when(F.col("o_orderkey") % 2 == 0, F.col("line")).otherwise(F.col("line") + 1))
    return records.diff_checked(rows, later, "o_orderkey", "line").agg(F.count_if(F.col("change") == "unchanged").alias("unchanged"), F.count_if(F.col("change") == "moved").alias("moved"))


@query(f"""SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'modified') AS replaced, count(*) FILTER (change = 'renamed') AS moved FROM ({ORACLE['manifest_changes']})""")
def changeset_summary(spark, d):
    keep = ("path", "size", "content_hash")
    a, b = _samples(spark, d)
    return review.file_changes(a.select(*keep), b.select(*keep))


_IMAGES = "SELECT lang AS label, source AS split, CASE WHEN doc_id % 7 <> 0 THEN doc_id * 13 % 2000 END AS width, CASE WHEN doc_id % 11 <> 0 THEN doc_id * 7 % 1900 END AS height, CASE WHEN doc_id % 3 = 0 THEN 'png' END AS media_format, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 3 END AS channels FROM documents"
_BUCKET = "CASE WHEN {c} IS NULL THEN 'unknown' WHEN {c} < 256 THEN '<256' WHEN {c} < 512 THEN '256-511' WHEN {c} < 1024 THEN '512-1023' ELSE '>=1024' END"
_DIMENSIONS = f"SELECT unnest(['split', 'label', 'width', 'height', 'aspect_ratio', 'format', 'channels']) AS dimension, unnest([split, label, {_BUCKET.format(c='width')}, {_BUCKET.format(c='height')}, CASE WHEN width IS NULL OR height IS NULL OR height = 0 THEN 'unknown' WHEN width / height < 0.8 THEN 'portrait' WHEN width / height <= 1.25 THEN 'square' ELSE 'landscape' END, coalesce(media_format, 'unknown'), CAST(channels AS VARCHAR)]) AS key FROM ({_IMAGES})"


@query(f"SELECT dimension, coalesce(key, 'unknown') AS key, count(*) AS n FROM ({_DIMENSIONS}) GROUP BY 1, 2")
def distribution_buckets(spark, d):
    k = F.col("doc_id")
    images = _read(spark, d, "documents").select(
        F.col("lang").alias("label"), F.col("source").alias("split"), F.when(k % 7 != 0, k * 13 % 2000).alias("width"), F.when(k % 11 != 0, k * 7 % 1900).alias("height"),
        F.when(k % 3 == 0, "png").alias("media_format"), F.when(k % 5 == 0, 1).otherwise(3).alias("channels"),
    )
    return review.distribution(review.in_buckets(images), review.DIMENSIONS).select("dimension", "key", "n")


_FILES = "SELECT CASE WHEN doc_id % 5 = 0 THEN 'train/cat/' WHEN doc_id % 5 = 1 THEN 'val/a b/' WHEN doc_id % 5 = 2 THEN 'other/cat/' WHEN doc_id % 5 = 3 THEN 'test/' ELSE 'test/dog/deep/' END || CAST(doc_id AS VARCHAR) || CASE doc_id % 3 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' ELSE '.jsonl' END AS path, n_chars * 20000 AS size, doc_id FROM documents"


def _files(spark, d):
    k = F.col("doc_id")
    folder = F.when(k % 5 == 0, "train/cat/").when(k % 5 == 1, "val/a b/").when(k % 5 == 2, "other/cat/").when(k % 5 == 3, "test/").otherwise("test/dog/deep/")
    suffix = F.when(k % 3 == 0, ".JPG").when(k % 3 == 1, ".png").otherwise(".jsonl")
    return _read(spark, d, "documents").select(F.concat(folder, k.cast("string"), suffix).alias("path"), (F.col("n_chars") * 20000).alias("size"), F.sha2(k.cast("string"), 256).alias("content_hash"))


@query(f"""SELECT path, CASE WHEN ok THEN split_part(path, '/', 1) END AS split, CASE WHEN ok THEN split_part(path, '/', 2) END AS label, CASE WHEN ok THEN regexp_replace(path, '^[^/]+/', '') END AS logical_path,
  CASE WHEN NOT ok THEN 'INVALID_LAYOUT' WHEN size > 33554432 THEN 'IMAGE_DECODE_SKIPPED' END AS code FROM (SELECT *, doc_id % 5 NOT IN (2, 3) AND doc_id % 3 <> 2 AS ok FROM ({_FILES}))""")
def image_layout(spark, d):
    return media.layout(_files(spark, d)).select("path", "split", "label", "logical_path", "code")


@query(f"SELECT sha256(CAST(doc_id AS VARCHAR)) AS content_hash FROM ({_FILES}) WHERE doc_id % 5 NOT IN (2, 3) AND doc_id % 3 <> 2 AND size <= 33554432 AND doc_id % 2 = 1")
def media_uncached(spark, d):
    cache = _read(spark, d, "documents").where("doc_id % 2 = 0").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("content_hash"))
    return media.uncached(media.layout(_files(spark, d)), cache)


@query(f"SELECT path FROM ({_FILES}) WHERE (doc_id % 5 IN (0, 1) AND doc_id % 3 <> 2) OR (doc_id % 5 = 4 AND doc_id % 3 = 0) OR (doc_id % 5 = 3 AND doc_id % 3 = 1)")
def import_selection(spark, d):
    return imports.select_files(_files(spark, d), ("*/*/*.JPG", "[tv]*/**/*.png", "t*/d?g/**"), ("test/dog/**/*.png", "**/*.jsonl", "other/**")).select("path")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 50000")
def view_document(spark, d):
    from tributary.plans.documents import parse_view

    view = parse_view('{"schema_version": 1, "predicates": [{"field": "o_orderstatus", "op": "in", "value": ["F", "O"]}, {"field": "o_totalprice", "op": "gte", "value": 50000}, {"field": "o_custkey", "op": "exists"}]}')
    return views.subset(_read(spark, d, "orders"), view["clauses"]).select("o_orderkey")


@query("SELECT 'value' AS field, 'RANGE' AS code, count(*) AS total FROM events WHERE value < 0.5 OR value > 100 HAVING count(*) > 0 UNION ALL SELECT 'event_type', 'ENUM', count(*) FROM events WHERE event_type NOT IN ('click', 'view')")
def policy_document(spark, d):
    from tributary.plans.documents import parse_policy

    doc = parse_policy('{"schema_version": 1, "adapter": "jsonl", "mode": "full", "fields": {"value": {"types": ["number"], "minimum": 0.5, "maximum": 100}, "event_type": {"types": ["string"], "enum": ["click", "view"]}}}')
    return policy.evaluate(_read(spark, d, "events"), "event_id", doc["rules"]).select("field", "code", "total")


@query("SELECT user_id, upper(event_type) AS kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) k FROM events WHERE value > 1) WHERE k = 1")
def recipe_document(spark, d):
    from tributary.plans.documents import parse_recipe

    doc = parse_recipe('{"kind": "prepare", "schema_version": 1, "source": {"format": "parquet"}, "output": {"format": "jsonl"}, "id_field": "user_id", "steps": [{"op": "filter", "field": "value", "predicate": "gt", "value": 1}, {"op": "dedupe", "by": ["user_id"], "keep": "first"}, {"op": "case", "fields": ["event_type"], "mode": "upper"}, {"op": "rename", "from": "event_type", "to": "kind"}, {"op": "select", "fields": ["user_id", "kind"]}]}')
    return recipe.apply_recipe(_read(spark, d, "events"), doc["steps"], ["event_id"], id_field=doc["id_field"])


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderkey AS HUGEINT) + 9007199254740992 > 9007199254741093")
def recipe_exact_numbers(spark, d):
    """Texts of numbers beyond 2^53, where doubles no longer tell neighbours apart."""
    rows = _read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") + 9007199254740992).cast("string").alias("n"))
    return recipe.apply_recipe(rows, [{"op": "filter", "field": "n", "predicate": "gt", "value": 9007199254741093}, {"op": "select", "fields": ["o_orderkey"]}], ["o_orderkey"])


@query("SELECT user_id AS id, count(*) AS n FROM events GROUP BY user_id")
def pipeline_document(spark, d):
    from tributary.plans.documents import parse_pipeline

    spec = parse_pipeline("schema_version: 1\npipeline: {name: users}\ntarget: {dataset: users, state: state, mode: create}\ninputs: [{alias: events, path: events.parquet, format: parquet}]\ntransform: {sql: 'SELECT user_id AS id, COUNT(*) AS n FROM events GROUP BY user_id ORDER BY id', id_field: id}\nexport: {split: [train=8, val=1, test=1]}\ndelivery: {output: out}\n")
    return transform(spark, spec["transform"]["sql"], {x["alias"]: readers.read_parquet(spark, [f"{d}/{x['path']}"]) for x in spec["inputs"]}, spec["transform"]["id_field"])


def queries() -> dict:
    return {name: _sql(name) for name in SQL} | QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in SQL.items()} | ORACLE
