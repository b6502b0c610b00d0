"""The registered queries of the library and their DuckDB SQL.

Money columns are doubles with two decimals; they become DECIMAL(18,2) before they
are summed, so results don't depend on the order of rows. The tables hold no nulls;
queries about nulls make them with an expression, alike in both engines.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import __version__, metrics
from ..cpu import cpu_features
from ..errors import ConfigError, EngineError, UnsupportedType
from ..functions.cleanup import CleanRule, clean_with_preset, clean_with_rules
from ..functions.json_normalize import normalize_columns, normalize_json, normalize_stats
from ..operators.aggregates import FUNCTIONS, aggregate
from ..operators.dedup import drop_duplicates
from ..operators.equivalence import check_equivalence
from ..operators.hashing import hash_rows, hash_rows_all_columns, row_hash, schema_fingerprint, table_fingerprint
from ..operators.joins import broadcast_join, join, join_null_safe
from ..operators.schema_check import validate_schema
from ..session import configure
from ..sources.tables import collect_as_record_batch, map_in_arrow, to_arrow_schema

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None):
    """Register a function under its name, with its SQL."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def _money(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("decimal(18,2)") for n in names})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["revenue_by_nation"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@_query("""
    SELECT n_name, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total, count(o_orderkey) AS n
    FROM (SELECT DISTINCT ON (o_orderkey) * FROM orders) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def revenue_by_nation(spark, table):
    orders = drop_duplicates(_money(table("orders"), "o_totalprice"), ["o_orderkey"])
    joined = join(orders, table("customer"), ["o_custkey"], ["c_custkey"])
    return aggregate(broadcast_join(joined, table("nation"), ["c_nationkey"], ["n_nationkey"]), ["n_name"], [("o_totalprice", "sum", "total"), ("o_orderkey", "count", "n")])


# --- aggregates


@_query("""
    SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS sum_price, CAST(sum(l_linenumber) AS BIGINT) AS sum_line,
           count(l_orderkey) AS n, CAST(min(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS min_price, max(l_quantity) AS max_quantity, CAST(sum(l_orderkey) AS BIGINT) AS sum_key
    FROM lineitem GROUP BY ALL""")
def agg_sum_count_minmax(spark, table):
    lines = _money(table("lineitem"), "l_extendedprice")
    return aggregate(
        lines,
        ["l_returnflag", "l_linestatus"],
        [("l_extendedprice", "sum", "sum_price"), ("l_linenumber", "sum", "sum_line"), ("l_orderkey", "count", "n"), ("l_extendedprice", "min", "min_price"), ("l_quantity", "max", "max_quantity"), ("l_orderkey", "sum", "sum_key")],
    )


@_query("SELECT p_brand, CAST(sum(p_size) AS DOUBLE) / count(p_size) AS mean_size, CAST(sum(p_partkey) AS DOUBLE) / count(p_partkey) AS mean_key FROM part GROUP BY p_brand")
def agg_mean_int(spark, table):
    return aggregate(table("part"), ["p_brand"], [("p_size", "mean", "mean_size"), ("p_partkey", "avg", "mean_key")])


@_query("SELECT event_type, round(sum(value) / count(value), 6) AS mean_value FROM events GROUP BY event_type")
def agg_mean_double(spark, table):
    return aggregate(table("events"), ["event_type"], [("value", "mean", "mean_value")]).withColumn("mean_value", F.round("mean_value", 6))


@_query("""
    SELECT c_mktsegment, CAST(CAST(sum(cents) // count(cents) AS DECIMAL(18,2)) / 100 AS DECIMAL(18,2)) AS mean_balance
    FROM (SELECT c_mktsegment, CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents FROM customer) GROUP BY c_mktsegment""")
def agg_mean_decimal_trunc(spark, table):
    return aggregate(_money(table("customer"), "c_acctbal"), ["c_mktsegment"], [("c_acctbal", "mean", "mean_balance")])


@_query("""
    SELECT o_orderpriority, count(v) AS n, CAST(sum(v) AS BIGINT) AS total, min(v) AS low, count(w) AS n_none, CAST(sum(w) AS BIGINT) AS total_none
    FROM (SELECT o_orderpriority, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS v, CASE WHEN o_orderkey < 0 THEN o_custkey END AS w FROM orders) GROUP BY o_orderpriority""")
def agg_nulls(spark, table):
    orders = table("orders").select("o_orderpriority", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).alias("v"), F.when(F.col("o_orderkey") < 0, F.col("o_custkey")).alias("w"))
    return aggregate(orders, ["o_orderpriority"], [("v", "count", "n"), ("v", "sum", "total"), ("v", "min", "low"), ("w", "count", "n_none"), ("w", "sum", "total_none")])


@_query("SELECT count(l_orderkey) AS n, CAST(sum(l_partkey) AS BIGINT) AS total, max(l_shipdate_day) AS last FROM (SELECT *, date_diff('day', TIMESTAMP '1970-01-01', date_trunc('day', l_shipdate)) AS l_shipdate_day FROM lineitem)")
def agg_whole_table(spark, table):
    lines = table("lineitem").withColumn("day", F.unix_date(F.col("l_shipdate").cast("date")).cast("long"))
    return aggregate(lines, [], [("l_orderkey", "count", "n"), ("l_partkey", "sum", "total"), ("day", "max", "last")])


@_query("SELECT count(l_orderkey) AS n, CAST(sum(l_partkey) AS BIGINT) AS total FROM lineitem WHERE false")
def agg_empty_whole_table(spark, table):
    return aggregate(table("lineitem").where("false"), [], [("l_orderkey", "count", "n"), ("l_partkey", "sum", "total")])


# --- joins


def _ordered(table):
    """Customers, and orders of which some have a customer that isn't there."""
    key = F.when(F.col("o_orderkey") % 7 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    return table("customer").select("c_custkey", "c_name"), table("orders").select("o_orderkey", key.alias("o_custkey"), F.col("o_orderstatus").alias("c_name"))


def _join_sql(kind: str) -> str:
    return f"""
    SELECT c_custkey, c.c_name AS c_name, o_orderkey, o_custkey, o.c_name AS c_name_right
    FROM customer c {kind} JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN -o_custkey ELSE o_custkey END AS o_custkey, o_orderstatus AS c_name FROM orders) o ON c_custkey = o_custkey"""


def _kinds():
    for how in ("inner", "left", "right", "full"):

        def make(spark, table, how=how):
            return join(*_ordered(table), ["c_custkey"], ["o_custkey"], how)

        make.__name__ = f"join_{how}"
        _query(_join_sql(how))(make)


_kinds()

_NULL_KEYS = "SELECT s_suppkey, nullif(s_nationkey % 5, 2) AS k FROM supplier"


def _null_keys(table):
    s = table("supplier").select("s_suppkey", F.nullif(F.col("s_nationkey") % 5, F.lit(2)).alias("k"))
    n = table("nation").select("n_nationkey", F.nullif(F.col("n_nationkey") % 5, F.lit(2)).alias("k"))
    return s, n


@_query(f"SELECT s_suppkey, s.k AS k, n_nationkey, n.k AS k_right FROM ({_NULL_KEYS}) s FULL JOIN (SELECT n_nationkey, nullif(n_nationkey % 5, 2) AS k FROM nation) n ON s.k = n.k")
def join_null_keys(spark, table):
    return join(*_null_keys(table), ["k"], ["k"], "full")


def _null_safe_kinds():
    for how in ("inner", "left", "right", "full"):

        def make(spark, table, how=how):
            s, n = _null_keys(table)
            # A key on either side that the other hasn't.
            s, n = s.unionByName(s.selectExpr("-s_suppkey AS s_suppkey", "CASE WHEN k = 1 THEN 77 ELSE k END AS k")), n.withColumn("k", F.expr("CASE WHEN k = 4 THEN 88 ELSE k END"))
            return join_null_safe(s, n, ["k"], ["k"], how)

        make.__name__ = f"join_null_safe_{how}"
        _query(f"""
            SELECT s_suppkey, s.k AS k, n_nationkey, n.k AS k_right
            FROM (SELECT * FROM ({_NULL_KEYS}) UNION ALL SELECT -s_suppkey, CASE WHEN k = 1 THEN 77 ELSE k END FROM ({_NULL_KEYS})) s
            {how} JOIN (SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 4 THEN 88 ELSE nullif(n_nationkey % 5, 2) END AS k FROM nation) n ON s.k IS NOT DISTINCT FROM n.k""")(make)


_null_safe_kinds()


@_query("""
    WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
    SELECT a.l_orderkey AS l_orderkey, a.l_linenumber AS l_linenumber, b.l_orderkey AS l_orderkey_right, b.l_linenumber AS l_linenumber_right
    FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber""")
def join_composite(spark, table):
    lines = drop_duplicates(table("lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])
    return join(lines, lines, ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber"])


def _broadcasts():
    for how in ("inner", "left"):

        def make(spark, table, how=how):
            return broadcast_join(table("customer").select("c_custkey", "c_nationkey"), table("nation").withColumn("n_nationkey", F.col("n_nationkey") * 2), ["c_nationkey"], ["n_nationkey"], how)

        make.__name__ = f"broadcast_{how}"
        _query(f"SELECT c_custkey, c_nationkey, n.* FROM customer {how} JOIN (SELECT n_nationkey * 2 AS n_nationkey, n_name, n_regionkey FROM nation) n ON c_nationkey = n_nationkey")(make)


_broadcasts()


# --- deduplication


@_query("SELECT doc_id, text, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def dedup_first(spark, table):
    return drop_duplicates(table("documents").select("doc_id", "text", "lang"), ["text"], ["doc_id"])


@_query("SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1")
def dedup_composite(spark, table):
    return drop_duplicates(table("events").select("event_id", "user_id", "event_type", "value"), ["user_id", "event_type"], ["event_id"])


@_query("SELECT DISTINCT nullif(c_nationkey, 3) AS k, c_mktsegment FROM customer")
def dedup_null_keys(spark, table):
    return drop_duplicates(table("customer").select(F.nullif(F.col("c_nationkey"), F.lit(3)).alias("k"), "c_mktsegment"), ["k", "c_mktsegment"])


@_query("SELECT DISTINCT * FROM lineitem")
def dedup_all_columns(spark, table):
    lines = table("lineitem")
    return drop_duplicates(lines, lines.columns)


@_query("SELECT CAST(most AS BIGINT) AS most, (SELECT count(DISTINCT c_nationkey) FROM customer) > most AS refused FROM range(22, 28) r(most)")
def dedup_bounded_keys(spark, table):
    def refused(most: int) -> bool:
        try:
            return drop_duplicates(table("customer"), ["c_nationkey"], max_distinct_keys=most) is None
        except MemoryError:
            return True

    return spark.createDataFrame([(most, refused(most)) for most in range(22, 28)], "most long, refused boolean")


# --- hashes and fingerprints


@_query("SELECT l_returnflag, count(DISTINCT (l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipdate)) AS n FROM lineitem GROUP BY l_returnflag")
def hash_distinct_groups(spark, table):
    hashed = hash_rows(table("lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"])
    return hashed.groupBy("l_returnflag").agg(F.count_distinct("row_hash").alias("n"))


@_query("SELECT count(*) AS n, count(*) AS different FROM customer WHERE c_custkey <> c_nationkey")
def hash_order_sensitive(spark, table):
    c = table("customer").where("c_custkey <> c_nationkey").select("c_custkey", F.col("c_nationkey").cast("long").alias("n"))
    return c.agg(F.count(F.lit(1)).alias("n"), F.count_if(row_hash(c, ["c_custkey", "n"]) != row_hash(c, ["n", "c_custkey"])).alias("different"))


@_query("""
    SELECT count(*) AS n, count(*) FILTER (c_name IS NOT NULL) AS null_differs, count(*) AS type_differs, count(*) AS zeros_agree, count(*) AS nans_agree, count(DISTINCT c_custkey) AS hashes
    FROM customer""")
def hash_null_and_types(spark, table):
    c = table("customer").select(
        "c_custkey", F.lit(None).cast("string").alias("none"), F.substring("c_name", 1, 0).alias("empty"), F.col("c_custkey").cast("int").alias("narrow"),
        (F.col("c_acctbal") * 0).alias("zero"), (F.col("c_acctbal") * -0.0).alias("minus_zero"), (F.col("c_acctbal") * float("nan")).alias("nan"), (F.col("c_custkey") * float("nan")).alias("other_nan"),
    )
    h = lambda n: row_hash(c, [n])
    return c.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(h("none") != h("empty")).alias("null_differs"), F.count_if(h("c_custkey") != h("narrow")).alias("type_differs"),
        F.count_if(h("zero") == h("minus_zero")).alias("zeros_agree"), F.count_if(h("nan") == h("other_nan")).alias("nans_agree"), F.count_distinct(h("c_custkey")).alias("hashes"),
    )


@_query("SELECT event_type, count(DISTINCT v) AS n FROM (SELECT event_type, CASE event_id % 4 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 0.0 WHEN 2 THEN -0.0 ELSE value END AS v FROM events) GROUP BY event_type")
def hash_special_doubles(spark, table):
    kind = F.col("event_id") % 4
    v = F.when(kind == 0, float("nan")).when(kind == 1, 0.0).when(kind == 2, -0.0).otherwise(F.col("value"))
    return hash_rows(table("events").select("event_type", v.alias("v")), ["v"]).groupBy("event_type").agg(F.count_distinct("row_hash").alias("n"))


@_query("""
    WITH g AS (SELECT n_nationkey % 5 AS g, list(n_regionkey ORDER BY n_regionkey) AS bag FROM nation GROUP BY ALL)
    SELECT a.g AS a, b.g AS b, a.bag = b.bag AS same FROM g a, g b""")
def fingerprint_pairs(spark, table):
    nation = table("nation")
    one = [table_fingerprint(nation.where(F.col("n_nationkey") % 5 == g), ["n_regionkey"]) for g in range(5)]
    other = [table_fingerprint(nation.where(F.col("n_nationkey") % 5 == g).orderBy(F.desc("n_name")).repartition(3), ["n_regionkey"]) for g in range(5)]
    return spark.createDataFrame([(a, b, one[a] == other[b]) for a in range(5) for b in range(5)], "a int, b int, same boolean")


# --- schemas

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
# Columns of all tables, with their types; by place, names of different tables agree.
_COLUMNS_SQL = f"SELECT table_name AS t, ordinal_position - 1 AS i, column_name AS name, data_type AS kind FROM information_schema.columns WHERE table_name IN {_TABLES}"


def _by_place(df: DataFrame) -> DataFrame:
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


@_query(f"WITH s AS (SELECT t, list(name || ' ' || kind ORDER BY i) AS l FROM ({_COLUMNS_SQL}) GROUP BY t) SELECT a.t AS a, b.t AS b, a.l = b.l AS same, a.l = b.l AS same_struct FROM s a, s b")
def schema_fingerprints(spark, table):
    frames = {t: table(t) for t in _TABLES}
    one, other = {t: schema_fingerprint(f) for t, f in frames.items()}, {t: schema_fingerprint(f.schema) for t, f in frames.items()}
    return spark.createDataFrame([(a, b, one[a] == one[b], one[a] == other[b]) for a in _TABLES for b in _TABLES], "a string, b string, same boolean, same_struct boolean")


def _diffs_sql(widening: bool, not_null: bool) -> str:
    wider = "NOT (w.kind = 'BIGINT' AND h.kind = 'INTEGER')" if widening else "true"
    nulls = "UNION ALL SELECT h.t, w.t, 'nullability', 'c' || w.i FROM w JOIN c h ON h.i = w.i WHERE w.i % 2 = 0" if not_null else ""
    return f"""
    WITH c AS ({_COLUMNS_SQL}), w AS (SELECT * FROM c), p AS (SELECT DISTINCT a.t AS have, b.t AS want FROM c a, c b),
    d(actual, expected, kind, name) AS (
        SELECT have, want, 'missing', 'c' || w.i FROM p JOIN w ON w.t = want WHERE NOT EXISTS (FROM c h WHERE h.t = have AND h.i = w.i)
        UNION ALL SELECT have, want, 'unexpected', 'c' || h.i FROM p JOIN c h ON h.t = have WHERE NOT EXISTS (FROM w WHERE w.t = want AND w.i = h.i)
        UNION ALL SELECT h.t, w.t, 'retyped', 'c' || w.i FROM w JOIN c h ON h.i = w.i WHERE h.kind <> w.kind AND {wider}
        {nulls})"""


def _diff_rows(table, widening: bool, not_null: bool = False):
    schemas = {t: _by_place(table(t)).schema for t in _TABLES}
    strict = {t: T.StructType([T.StructField(f.name, f.dataType, i % 2 == 1) for i, f in enumerate(s.fields)]) for t, s in schemas.items()}
    for a in _TABLES:
        for b in _TABLES:
            yield a, b, validate_schema(schemas[a], (strict if not_null else schemas)[b], widening)


def _schema_diffs():
    for name, widening, not_null in (("schema_diffs", False, False), ("schema_diffs_widening", True, False), ("schema_diffs_nullability", True, True)):

        def make(spark, table, widening=widening, not_null=not_null):
            rows = []
            for a, b, diff in _diff_rows(table, widening, not_null):
                kinds = (("missing", diff.missing), ("unexpected", diff.unexpected), ("retyped", [r.name for r in diff.retyped]), ("nullability", [c.name for c in diff.nullability]))
                rows += [(a, b, kind, n) for kind, names in kinds for n in names]
            return spark.createDataFrame(rows, "actual string, expected string, kind string, name string")

        make.__name__ = name
        _query(_diffs_sql(widening, not_null) + " SELECT * FROM d")(make)


_schema_diffs()


@_query(_diffs_sql(True, False) + """
    SELECT have AS actual, want AS expected, count(d.kind) = 0 AS is_empty, count(d.kind) FILTER (d.kind <> 'unexpected') > 0 AS is_breaking
    FROM p LEFT JOIN d ON actual = have AND expected = want GROUP BY ALL""")
def schema_verdicts(spark, table):
    return spark.createDataFrame([(a, b, d.is_empty, d.is_breaking) for a, b, d in _diff_rows(table, True)], "actual string, expected string, is_empty boolean, is_breaking boolean")


@_query(f"""
    SELECT t, name, CASE kind WHEN 'BIGINT' THEN 'int64' WHEN 'INTEGER' THEN 'int32' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp[us]' WHEN 'FLOAT[]' THEN 'list<element: float>' END AS arrow
    FROM ({_COLUMNS_SQL})""")
def arrow_schemas(spark, table):
    return spark.createDataFrame([(t, f.name, str(f.type)) for t in _TABLES for f in to_arrow_schema(table(t))], "t string, name string, arrow string")


@_query(f"""
    SELECT t, name, function, function <> 'count' AND kind NOT IN ('BIGINT', 'INTEGER', 'DOUBLE') AS refused
    FROM ({_COLUMNS_SQL}), (VALUES ('count'), ('sum'), ('mean'), ('avg'), ('min'), ('max')) f(function)""")
def agg_type_gate(spark, table):
    def refused(df, name: str, function: str) -> bool:
        try:
            return aggregate(df, [], [(name, function, "x")]) is None
        except UnsupportedType:
            return True

    rows = [(t, n, f, refused(df, n, f)) for t in _TABLES for df in [table(t)] for n in df.columns for f in FUNCTIONS]
    return spark.createDataFrame(rows, "t string, name string, function string, refused boolean")


@_query(f"""
    WITH c AS (SELECT * FROM ({_COLUMNS_SQL}) WHERE t IN ('customer', 'orders'))
    SELECT a.name AS a, b.name AS b, a.kind <> b.kind AS refused FROM c a, c b WHERE a.t = 'customer' AND b.t = 'orders'
    UNION ALL SELECT a.name, '', true FROM c a WHERE a.t = 'customer'""")
def join_key_checks(spark, table):
    c, o = table("customer"), table("orders")

    def refused(a: list[str], b: list[str]) -> bool:
        try:
            return join(c, o, a, b) is None
        except EngineError:
            return True

    rows = [(a, b, refused([a], [b])) for a in c.columns for b in o.columns] + [(a, "", refused([a], [])) for a in c.columns]
    return spark.createDataFrame(rows, "a string, b string, refused boolean")


# --- equivalence


def _equivalences():
    cases = {
        "equiv_fast_true": (lambda s: s.repartition(5), False, "SELECT * FROM supplier"),
        "equiv_fast_false": (lambda s: s.withColumn("s_acctbal", F.when(F.col("s_suppkey") == 1, 0.5).otherwise(F.col("s_acctbal"))), False, "SELECT * REPLACE (CASE WHEN s_suppkey = 1 THEN 0.5 ELSE s_acctbal END AS s_acctbal) FROM supplier"),
        "equiv_exact": (lambda s: s.orderBy(F.desc("s_name")), True, "SELECT * FROM supplier ORDER BY s_name DESC"),
        "equiv_exact_false": (lambda s: s.where("s_suppkey <> 2").unionByName(s.where("s_suppkey = 3")), True, "SELECT * FROM supplier WHERE s_suppkey <> 2 UNION ALL SELECT * FROM supplier WHERE s_suppkey = 3"),
    }
    for name, (change, exact, changed) in cases.items():

        def make(spark, table, change=change, exact=exact):
            s = table("supplier")
            report = check_equivalence(change(s), s, exact=exact)
            return spark.createDataFrame([(report.actual_rows, report.expected_rows, report.is_equivalent)], "actual_rows long, expected_rows long, equivalent boolean")

        make.__name__ = name
        _query(f"""
            WITH a AS ({changed})
            SELECT (SELECT count(*) FROM a) AS actual_rows, (SELECT count(*) FROM supplier) AS expected_rows,
                   NOT EXISTS (FROM a EXCEPT ALL FROM supplier) AND NOT EXISTS (FROM supplier EXCEPT ALL FROM a) AS equivalent""")(make)


_equivalences()


# --- tables, batches, events


@_query("SELECT * FROM nation")
def batch_of_nations(spark, table):
    batch = collect_as_record_batch(table("nation").repartition(4))
    return spark.createDataFrame(pa.Table.from_batches([batch]))


@_query("SELECT c_custkey, upper(c_mktsegment) AS segment FROM customer")
def batches_mapped(spark, table):
    def shout(batches):
        import pyarrow.compute as pc

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("c_custkey"), pc.utf8_upper(b.column("c_mktsegment"))], names=["c_custkey", "segment"])

    return map_in_arrow(table("customer").select("c_custkey", "c_mktsegment"), shout, "c_custkey long, segment string")


@_query("""
    SELECT 'collect_as_record_batch' AS function, 'ok' AS status, CAST(NULL AS VARCHAR) AS columns, 'first' AS enabled, count(*) AS rows_out FROM nation
    UNION ALL SELECT 'hash_rows', 'ok', 'n_name,n_regionkey', 'first', NULL
    UNION ALL SELECT 'aggregate', 'error', NULL, 'first', NULL
    UNION ALL SELECT 'load', 'ok', NULL, 'first', count(*) FROM region""")
def metric_events(spark, table):
    """Events of calls while metrics are on; none of a call after they are off."""
    events: list[dict] = []
    metrics.enable(events.append)
    enabled = "first" if metrics.is_enabled() else "never"
    try:
        collect_as_record_batch(table("nation"))
        hash_rows(table("nation"), ["n_name", "n_regionkey"])
        with suppress(UnsupportedType):
            aggregate(table("nation"), [], [("n_name", "sum", "s")])
        with metrics.measure("load") as event:
            event["rows_out"] = metrics.row_count(table("region").toArrow())
    finally:
        metrics.disable()
    hash_rows(table("nation"), ["n_name"])
    rows = [(e["function"], e["status"], ",".join(c) if (c := e.get("columns")) else None, enabled, e.get("rows_out")) for e in events]
    return spark.createDataFrame(rows, "function string, status string, columns string, enabled string, rows_out long")


@_query(None)
def engine_facts(spark, table):
    """The library's version and the instruction sets of the driver's machine."""
    found = cpu_features()
    return spark.createDataFrame([(__version__, *[getattr(found, f) for f in ("sse42", "avx2", "avx512f", "neon")])], "version string, sse42 boolean, avx2 boolean, avx512f boolean, neon boolean")


# --- JSON


@_query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_events_props(spark, table):
    return normalize_columns(table("events"), "props", "k BIGINT", keep=["event_id"])


# Real columns as objects; every seventh text is cut off, every fifth has a name for a number.
_CUSTOMERS_SQL = "SELECT *, c_custkey % 7 = 0 AS cut, c_custkey % 5 = 0 AS odd FROM customer"


def _objects(table):
    c = table("customer")
    odd = F.to_json(F.struct(F.col("c_name").alias("id"), F.struct(F.col("c_mktsegment").alias("segment")).alias("in"), F.col("c_acctbal").alias("balance")))
    even = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.struct(F.col("c_mktsegment").alias("segment")).alias("in"), F.col("c_acctbal").alias("balance")))
    text = F.when(F.col("c_custkey") % 5 == 0, odd).otherwise(even)
    return c.select("c_custkey", text.alias("j")).selectExpr("c_custkey", "CASE WHEN c_custkey % 7 = 0 THEN substring(j, 1, length(j) - 1) ELSE j END AS j")


@_query(f"""
    SELECT c_custkey, CASE WHEN NOT cut AND NOT odd THEN c_custkey END AS id, CASE WHEN NOT cut THEN c_mktsegment END AS "in.segment", CASE WHEN NOT cut THEN c_acctbal END AS balance FROM ({_CUSTOMERS_SQL})""")
def json_customers(spark, table):
    return normalize_json(_objects(table), "j", "id BIGINT, `in.segment` STRING, balance DOUBLE", keep=["c_custkey"])[0]


@_query(f"""
    SELECT count(*) AS n, count(*) FILTER (cut) AS malformed, count(*) FILTER (odd AND NOT cut) AS id_mismatches, count(*) FILTER (NOT cut) AS segment_mismatches FROM ({_CUSTOMERS_SQL})""")
def json_customer_stats(spark, table):
    stats = normalize_json(_objects(table), "j", "id BIGINT, `in.segment` BOOLEAN")[1]
    return spark.createDataFrame([(stats.rows, stats.rows_malformed, *stats.type_mismatches.values())], "n long, malformed long, id_mismatches long, segment_mismatches long")


# Texts by doc_id modulo 8, and what they give.
_TEXTS = ('{"id": 1, "a": {"b": "x"}, "f": 2}', '{"id": "no", "f": 1.5, "t": true}', "[1]", "no json", '{"id": 1.0, "a": 3}', '{"id": null}', '{"id": 5} x', "{}")


def _mixed(table):
    text = F.element_at(F.array(*[F.lit(x) for x in _TEXTS]), (F.col("doc_id") % 8 + 1).cast("int"))
    return table("documents").select(F.when(F.col("doc_id") % 11 > 0, text).alias("j"), "doc_id")


_MIXED_SQL = "SELECT doc_id, CASE WHEN doc_id % 11 > 0 THEN doc_id % 8 ELSE -1 END AS c FROM documents"


@_query(f"""
    SELECT CAST(CASE WHEN c = 0 THEN 1 END AS BIGINT) AS id, CASE WHEN c = 0 THEN 'x' END AS "a.b", CAST(CASE c WHEN 0 THEN 2.0 WHEN 1 THEN 1.5 END AS DOUBLE) AS f, CASE WHEN c = 1 THEN true END AS t
    FROM ({_MIXED_SQL})""")
def json_mixed(spark, table):
    return normalize_columns(_mixed(table), "j", "id BIGINT, `a.b` STRING, f DOUBLE, t BOOLEAN")


@_query(f"""
    SELECT count(*) AS n, count(*) FILTER (c IN (-1, 2, 3, 6)) AS malformed, count(*) FILTER (c IN (1, 4)) AS id_mismatches, count(*) FILTER (c = 9) AS ab_mismatches FROM ({_MIXED_SQL})""")
def json_stats(spark, table):
    stats = normalize_stats(_mixed(table), "j", "id BIGINT, `a.b` STRING")
    return spark.createDataFrame([(stats.rows, stats.rows_malformed, *stats.type_mismatches.values())], "n long, malformed long, id_mismatches long, ab_mismatches long")


# --- cleanup

_WS = r"[\t-\r \x{85}\p{Z}]"
_MESSY_SQL = "SELECT doc_id, '  ' || text || chr(9) || chr(9) || chr(160) || chr(7) || '-' || chr(8195) AS m FROM documents"


def _messy(table):
    return table("documents").select("doc_id", F.concat(F.lit("  "), "text", F.lit("\t\t\xa0\x07- ")).alias("m"))


def _presets():
    sql = {
        "trim_whitespace": f"regexp_replace(regexp_replace(m, '^{_WS}+', ''), '{_WS}+$', '')",
        "collapse_whitespace": f"regexp_replace(m, '{_WS}+', ' ', 'g')",
        "strip_control_characters": r"regexp_replace(m, '[\x00-\x1F\x7F]', '', 'g')",
        "strip_non_alphanumeric": rf"regexp_replace(m, '[^A-Za-z0-9\t-\r \x{{85}}\p{{Z}}]', '', 'g')",
        "digits_only": "regexp_replace(m, '[^0-9]', '', 'g')",
    }
    for name, expression in sql.items():

        def make(spark, table, name=name):
            return clean_with_preset(_messy(table), "m", name)

        make.__name__ = f"clean_{name}"
        _query(f"SELECT doc_id, {expression} AS m FROM ({_MESSY_SQL})")(make)


_presets()


_PATTERNS = ("{}+", "({}", "{}(?=a)", "(?<=a){}", "({})\\1", "[{}]", "{}|x", "(?!a){}", "{}{{2,3}}", "*{}")


@_query("SELECT n_name, p.pattern AS pattern, TRY(regexp_matches('', replace(replace(replace(pattern, '{}', n_name), '{{', '{'), '}}', '}'))) IS NULL AS refused FROM nation, (VALUES " + ", ".join(f"('{p}')" for p in _PATTERNS) + ") p(pattern)")
def clean_refused_patterns(spark, table):
    """Patterns out of names: those beyond a linear-time dialect are refused as rules."""

    def refused(pattern: str) -> bool:
        try:
            return CleanRule(pattern, "") is None
        except ConfigError:
            return True

    names = [r[0] for r in table("nation").select("n_name").collect()]
    return spark.createDataFrame([(n, p, refused(p.format(n))) for n in names for p in _PATTERNS], "n_name string, pattern string, refused boolean")


@_query(r"SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '([a-z]+) +([a-z]+)', '\2_\1', 'g') AS cleaned FROM pages")
def clean_rules_ordered(spark, table):
    rules = [("<[^>]*>", " "), ("(?P<first>[a-z]+) +([a-z]+)", "${2}_$first")]
    return clean_with_rules(table("pages").select("page_id", "html"), "html", rules, "cleaned").select("page_id", "cleaned")


@_query("SELECT count(*) AS n, count(DISTINCT (c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment)) AS hashes FROM customer")
def hash_all_columns(spark, table):
    return hash_rows_all_columns(table("customer")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_hash").alias("hashes"))
