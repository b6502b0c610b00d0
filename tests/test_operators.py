"""The table operators on small literal tables."""

from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt import metrics
from basalt.cpu import CpuFeatures, cpu_features
from basalt.errors import ConfigError, SchemaMismatch, TypeMismatch, UnknownColumn, UnsupportedType
from basalt.functions.cleanup import CleanRule, clean_with_preset, clean_with_rules, preset, translate_pattern
from basalt.functions.json_normalize import normalize_json, normalize_stats
from basalt.operators.aggregates import aggregate
from basalt.operators.dedup import drop_duplicates
from basalt.operators.equivalence import check_equivalence
from basalt.operators.hashing import hash_rows, hash_rows_all_columns, row_hash, schema_fingerprint, table_fingerprint
from basalt.operators.joins import broadcast_join, join, join_null_safe
from basalt.operators.schema_check import NullabilityChange, Retyped, validate_schema
from basalt.sources.tables import collect_as_record_batch, map_in_arrow, read_tables, to_arrow_schema
from basalt.streaming.rowwise import drop_duplicates_within
from tests.oracle import SF

MAX = 2**63 - 1
NAN = float("nan")


def tuples(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- aggregates


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([("tin", 7), ("zinc", 40), ("tin", 2), ("zinc", None), ("tin", 91), ("tin", -3)], "metal string, weight long")


def test_aggregate(sales):
    got = tuples(aggregate(sales, ["metal"], [("weight", f, f) for f in ("sum", "count", "min", "max", "mean")]))
    assert got == [("tin", 97, 4, -3, 91, 97 / 4), ("zinc", 40, 1, 40, 40, 40.0)]
    assert tuples(aggregate(sales, [], [("weight", "sum", "s"), ("metal", "count", "n")])) == [(137, 6)]
    empty = sales.where("false")
    assert tuples(aggregate(empty, [], [("weight", "count", "n"), ("weight", "sum", "s"), ("weight", "avg", "m")])) == [(0, None, None)]
    assert tuples(aggregate(empty, ["metal"], [("weight", "count", "n")])) == []
    schema = aggregate(sales, ["metal"], [("weight", "count", "n"), ("weight", "sum", "s")]).schema
    assert schema["n"].dataType == T.LongType() and not schema["n"].nullable and schema["s"].dataType == T.LongType()


def test_exact_sums(spark):
    big = lambda *v: aggregate(spark.createDataFrame([("g", x) for x in v], "g string, v long"), ["g"], [("v", "sum", "s")])
    assert tuples(big(MAX - 2, 1)) == [("g", MAX - 1)]
    assert tuples(big(MAX, MAX, -MAX)) == [("g", MAX)]
    assert tuples(big(-MAX - 1, 5, -3)) == [("g", -MAX + 1)]
    with pytest.raises(Exception, match="OVERFLOW"):
        big(MAX, MAX).collect()
    two = spark.createDataFrame([(2**53 + 1,), (2**53 + 2,)], "v long")
    assert tuples(aggregate(two, [], [("v", "min", "a"), ("v", "max", "b"), ("v", "sum", "c")])) == [(2**53 + 1, 2**53 + 2, 2**54 + 3)]
    small = spark.createDataFrame([(2**31 - 1, 100), (2**31 - 1, 27)], "a int, b byte")
    assert tuples(aggregate(small, [], [("a", "sum", "a"), ("b", "sum", "b"), ("b", "mean", "c")])) == [(2**32 - 2, 127, 63.5)]


@pytest.mark.parametrize(("kind", "values", "mean"), [("decimal(20,2)", ["10.00", "20.00", "0.05"], "10.01"), ("decimal(20,2)", ["-10.00", "-20.00", "-0.05"], "-10.01"), ("decimal(18,10)", ["0.0000000001", "0.0000000002"], "0.0000000001"), ("decimal(5,0)", ["7", "8"], "7")])
def test_decimals(spark, kind, values, mean):
    df = spark.createDataFrame([(Decimal(v),) for v in values], f"v {kind}")
    out = aggregate(df, [], [("v", "sum", "s"), ("v", "mean", "m"), ("v", "max", "x")])
    assert tuples(out) == [(sum(map(Decimal, values)), Decimal(mean), max(map(Decimal, values)))]
    assert {f.dataType.simpleString() for f in out.schema} == {kind}


def test_floats(spark):
    df = spark.createDataFrame([(0.0, 1.5), (-0.0, 2.5), (NAN, 1.0), (NAN, NAN)], "k double, v float")
    got = aggregate(df, ["k"], [("v", "sum", "s"), ("v", "max", "x")]).collect()
    assert len(got) == 2 and {str(r.s) for r in got} == {"4.0", "nan"}


def test_aggregate_errors(sales):
    for error, args in (
        (UnknownColumn, (["Metal"], [("weight", "sum", "s")])), (UnsupportedType, ([], [("metal", "max", "m")])), (ValueError, ([], [("weight", "median", "m")])),
        (ValueError, (["metal"], [("weight", "sum", "metal")])), (ValueError, ([], [("weight", "sum", "s"), ("weight", "max", "s")])), (ValueError, (["metal"], [])),
    ):
        with pytest.raises(error):
            aggregate(sales, *args)


# --- joins


def test_joins(spark):
    users = spark.createDataFrame([(10, "oak"), (20, "elm"), (30, "yew")], "id long, name string")
    orders = spark.createDataFrame([(20, "leaf"), (20, "root"), (20, "seed"), (40, "bark"), (50, "cone")], "user_id long, item string")
    counts = {how: join(users, orders, ["id"], ["user_id"], how).count() for how in ("inner", "left", "right", "full")}
    assert counts == {"inner": 3, "left": 5, "right": 5, "full": 7}
    assert join(users, users, ["id"], ["id"]).columns == ["id", "name", "id_right", "name_right"]
    assert tuples(broadcast_join(users, orders, ["id"], ["user_id"], "left"))[-1] == (30, "yew", None, None)
    nation, region = read_tables(spark, SF, ["nation", "region"]).values()
    plan = lambda **k: broadcast_join(nation, region, ["n_regionkey"], ["r_regionkey"], **k)._jdf.queryExecution().analyzed().toString()
    assert "hint" in plan().lower() and "hint" not in plan(max_bytes=1).lower()
    a = spark.createDataFrame([(None, 1), (1, 2)], "k long, v long")
    assert join(a, a, ["k"], ["k"]).count() == 1 and join(a, a, ["k"], ["k"], "full").count() == 3 and join_null_safe(a, a, ["k"], ["k"]).count() == 2
    x, y = spark.createDataFrame([(None, "x")], "a long, b string"), spark.createDataFrame([(None, "y")], "a long, b string")
    assert join_null_safe(x, y, ["a", "b"], ["a", "b"]).count() == 0


def test_join_errors(spark):
    a, b = spark.range(1), spark.createDataFrame([("1", 1)], "id string, id_right long")
    for error, args in (
        (TypeMismatch, (a, b.select("id"), ["id"], ["id"])), (ConfigError, (a, b, [], [])), (ConfigError, (a, b, ["id"], ["id", "id_right"])),
        (UnknownColumn, (a, b, ["ID"], ["id"])), (ValueError, (a, a, ["id"], ["id"], "left_outer")), (SchemaMismatch, (b, b.select("id"), ["id"], ["id"])),
        (TypeMismatch, (a, spark.range(1).selectExpr("int(id) AS k"), ["id"], ["k"])),
    ):
        with pytest.raises(error):
            join(*args)
    with pytest.raises(ValueError):
        broadcast_join(a, a, ["id"], ["id"], "right")


# --- dedup


def test_dedup(spark):
    df = spark.createDataFrame([(1, "first"), (1, "second"), (2, "x"), (None, "n"), (None, "m")], "id long, label string")
    assert drop_duplicates(df, ["id"]).count() == 3 and drop_duplicates(df, ["id", "label"]).count() == 5
    assert tuples(drop_duplicates(df, ["id"], ["label"])) == [(1, "first"), (2, "x"), (None, "m")]
    odd = spark.createDataFrame([(0.0, 1), (-0.0, 2), (NAN, 3), (NAN, 4)], "`a.b` double, n int")
    assert [r.n for r in drop_duplicates(odd, ["a.b"], ["n"]).orderBy("n").collect()] == [1, 3]
    assert drop_duplicates(odd, ["a.b"]).count() == 2
    assert drop_duplicates(df, ["id"], max_distinct_keys=3).count() == 3
    with pytest.raises(MemoryError):
        drop_duplicates(df, ["id"], max_distinct_keys=2)
    for error, columns in ((ValueError, []), (UnknownColumn, ["nope"])):
        with pytest.raises(error):
            drop_duplicates(df, columns)
    with pytest.raises(UnsupportedType):
        drop_duplicates(spark.createDataFrame([([1],)], "v array<int>"), ["v"])


# --- hashes


def hash_of(spark, expression):
    df = spark.sql(f"SELECT {expression} AS v")
    return df.select(row_hash(df, ["v"])).first()[0]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("CAST(NULL AS STRING)", "''", False), ("5", "5L", False), ("1", "true", False), ("DATE'1970-01-06'", "5", False), ("0D", "-0D", True), ("double('NaN')", "double('NaN') + 1", True),
        ("CAST(5 AS DECIMAL(10,2))", "CAST(5 AS DECIMAL(10,0))", False), ("TIMESTAMP_NTZ'1970-01-01'", "TIMESTAMP'1970-01-01'", False), ("'a'", "X'61'", False), ("float('0')", "float('-0')", True),
    ],
)
def test_value_hashes(spark, a, b, same):
    assert (hash_of(spark, a) == hash_of(spark, b)) is same


def test_row_hashes(spark):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, NAN), (3, "c", -0.0)], "id long, name string, score double")
    first, again = (hash_rows(df, ["id", "name"]).collect() for _ in range(2))
    assert [r[-1] for r in first] == [r[-1] for r in again] and hash_rows_all_columns(df).columns[-1] == "row_hash"
    assert {r[-1] for r in hash_rows(df, ["name", "id"]).collect()}.isdisjoint({r[-1] for r in first})
    shifted = spark.createDataFrame([(None, 1), (1, None)], "a long, b long")
    assert len({r[-1] for r in hash_rows_all_columns(shifted).collect()}) == 2
    for error, call in ((UnknownColumn, lambda: hash_rows(df, ["x"])), (SchemaMismatch, lambda: hash_rows(df, ["id"], "name")), (ValueError, lambda: hash_rows(df, ["id"], version="v9"))):
        with pytest.raises(error):
            call()
    assert table_fingerprint(df) == table_fingerprint(df.orderBy(F.desc("id"))) != table_fingerprint(df.union(df.limit(1)))
    assert table_fingerprint(df.where("false")) == table_fingerprint(df.where("id > 9")) != 0


def test_schema_fingerprints():
    s = T.StructType.fromDDL
    base = schema_fingerprint(s("a INT, b STRING"))
    assert base == schema_fingerprint(s("a INT, b STRING"))
    assert len({base, schema_fingerprint(s("b STRING, a INT")), schema_fingerprint(s("a INT NOT NULL, b STRING")), schema_fingerprint(s("ab INT, b STRING"))}) == 4


# --- schemas, equivalence


def test_validate_schema():
    check = validate_schema
    assert check("id BIGINT, e STRING", "id BIGINT, e STRING").is_empty
    diff = check("id INT, extra STRING", "id BIGINT, email STRING")
    assert (diff.missing, diff.unexpected, diff.retyped) == (["email"], ["extra"], [Retyped("id", "bigint", "int")]) and diff.is_breaking
    assert check("id INT", "id BIGINT", True).is_empty and not check("id BIGINT", "id INT", True).is_empty and not check("id INT", "id DOUBLE", True).is_empty
    assert not check("id INT, x INT", "id INT").is_breaking
    assert check("id INT", "id BIGINT NOT NULL", True).nullability == [NullabilityChange("id", False, True)]
    assert check("id INT NOT NULL", "id INT").is_empty
    assert check("ID INT", "id INT").missing == ["id"]
    with pytest.raises(SchemaMismatch):
        check("a INT, a INT", "a INT")


def test_equivalence(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, name string")
    same = a.orderBy(F.desc("id")).select("name", "id")
    for exact in (False, True):
        assert check_equivalence(same, a, exact=exact).is_equivalent
        changed = check_equivalence(a.withColumn("name", F.lit("z")), a, exact=exact)
        assert not changed.fingerprints_match and not changed.is_equivalent and changed.exact_match is (False if exact else None)
        assert not check_equivalence(a.distinct(), a, exact=exact).is_equivalent
        assert check_equivalence(a.withColumn("name", F.lit("z")), a, columns=["id"], exact=exact).is_equivalent
    narrow = a.withColumn("id", F.col("id").cast("int"))
    report = check_equivalence(narrow, a, allow_numeric_widening=True, exact=True)
    assert report.schema_diff.is_empty and not report.fingerprints_match and report.exact_match is False
    assert check_equivalence(a.drop("name"), a).schema_diff.missing == ["name"]
    apart = check_equivalence(a.select("id"), a.select(F.col("name").alias("other")), exact=True)
    assert apart.fingerprints_match and apart.exact_match and not apart.is_equivalent
    swapped = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, name string")
    assert check_equivalence(swapped, a, exact=True).exact_match is False
    with pytest.raises(UnsupportedType):
        check_equivalence(*[spark.createDataFrame([([1],)], "v array<int>")] * 2)


# --- cleanup


def cleaned(spark, text, *rules):
    return clean_with_rules(spark.createDataFrame([(text,)], "s string"), "s", rules).first()[0]


def test_presets(spark):
    one = lambda name, text: clean_with_preset(spark.createDataFrame([(text,)], "s string"), "s", name).first()[0]
    assert one("trim_whitespace", "  hello \n") == "hello" and one("collapse_whitespace", "  a    b\t\tc  ") == " a b c "
    assert one("strip_control_characters", "a\x07b\x1bc\n") == "abc" and one("strip_non_alphanumeric", "a-b_c!d 1") == "abcd 1"
    assert one("digits_only", "+1 (555) 123-4567") == "15551234567" and one("digits_only", None) is None
    with pytest.raises(ValueError):
        preset("nope")
    with pytest.raises(ValueError):
        preset("digits_only", "v2")


@pytest.mark.parametrize(
    ("rule", "text", "want"),
    [
        ((r"\s+", "_"), "a  b", "a_b"), ((r"b$", "X"), "b\n", "b\n"), ((r"(?m)b$", "X"), "b\nb", "X\nX"), ((r"(a)(b)", "$2$1"), "ab", "ba"), ((r"(a)", "$1x"), "a", ""), ((r"(a)", "${1}x"), "a", "ax"),
        ((r"(a)", "${1}0"), "a", "a0"), ((r"a", "$$"), "a", "$"), ((r"a", "\\"), "a", "\\"), ((r"(?P<le_ft>a)", "<$le_ft>"), "a", "<a>"), ((r"a", "$9"), "a", ""), ((r"(?i)É", "x"), "é", "x"),
        ((r"\d", "#"), "٣", "#"), ((r"[[:digit:]]", "#"), "٣3", "٣#"), ((r"\p{Greek}", "g"), "αa", "ga"), ((r"\v", "x"), "\x0b\n", "x\n"), ((r"[]a]", "x"), "]a", "xx"), ((r"\u{61}", "b"), "a", "b"), ((r"[^\s]", "x"), "a b", "x x"),
    ],
)
def test_rules(spark, rule, text, want):
    assert cleaned(spark, text, rule) == want


def test_rule_order_and_columns(spark):
    assert cleaned(spark, "a", ("a", "b"), ("b", "c")) == "c" and cleaned(spark, None, ("a", "b")) is None
    df = spark.createDataFrame([("x1", 2)], "s string, n int")
    assert clean_with_rules(df, "s", [("[0-9]", "")], "t").columns == ["s", "n", "t"]
    for error, call in ((UnsupportedType, lambda: clean_with_preset(df, "n", "digits_only")), (SchemaMismatch, lambda: clean_with_preset(df, "s", "digits_only", "n")), (UnknownColumn, lambda: clean_with_preset(df, "S", "digits_only"))):
        with pytest.raises(error):
            call()


@pytest.mark.parametrize("pattern", ["(a|b", "x(?=y)", "(?<=x)y", "(?!x)", "(?<!x)y", r"(a)b\1", r"(?P<a>x)\k<a>", "a++", "a*+", "(?>a)", "[a--b]", r"\Qx\E", "\\", "(?U)a", r"\G"])
def test_refused_patterns(spark, pattern):
    with pytest.raises(ConfigError):
        CleanRule(pattern, "")


def test_translation_keeps_plain_patterns():
    assert translate_pattern(r"[a-z]+\.(x|y)?").pattern == r"(?Ud)[a-z]+\.(x|y)?"


# --- JSON


def test_normalize_json(spark):
    texts = ['{"id": 17, "name": "k", "active": false, "address": {"city": "Bergen"}}', "{id: 3", "[[]]", "-0.5", '"{}"', '{"id": 8}', '{"id": null, "name": "k"}', '{"id": "seven"}', None,
             '{"id": 1.0}', '{"id": 9223372036854775808}', '{"id": 1} x', '{"id": 1, "id": 2}', '{"address": "flat"}', '{"address": {"city": 5}}', '{"id": 1}, {"id": 2}', '{}', ""]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, j string")
    out, stats = normalize_json(df, "j", "id BIGINT, name STRING, active BOOLEAN, `address.city` STRING, score DOUBLE")
    got = list(map(tuple, out.collect()))
    none = (None,) * 5
    want = [(17, "k", False, "Bergen", None), none, none, none, none, (8, None, None, None, None), (None, "k", None, None, None), none, none, none, none, none, (2, None, None, None, None), none, none, none, none, none]
    assert got == want
    assert stats.rows == len(texts) and stats.rows_malformed == 8
    assert stats.type_mismatches == {"id": 3, "name": 0, "active": 0, "address.city": 1, "score": 0}
    # What closes the array around a text, or lengthens it, is no object.
    odd = spark.createDataFrame([('{"id": 1}]',), ('{"id": 1}, 2',), ('{"id": 1}, 2]',), ('{"id": 1}}',)], "j string")
    assert normalize_json(odd, "j", "id BIGINT")[1].rows_malformed == 4
    kept, _ = normalize_json(df, "j", "id BIGINT", keep=["n"])
    assert [tuple(r) for r in kept.orderBy("n").limit(2).collect()] == [(0, 17), (1, None)] and kept.columns == ["n", "id"]
    assert normalize_stats(df, "j", "id BIGINT") == normalize_json(df, "j", "id BIGINT")[1].get()
    with pytest.raises(SchemaMismatch):
        normalize_json(df.withColumnRenamed("n", "id"), "j", "id BIGINT", keep=["id"])
    for error, schema in ((UnsupportedType, "v DATE"), (SchemaMismatch, "v STRING NOT NULL"), (SchemaMismatch, "v STRING, v STRING")):
        with pytest.raises(error):
            normalize_json(df, "j", schema)
    with pytest.raises(UnsupportedType):
        normalize_json(df, "n", "v STRING")


# --- the rest


def test_metrics():
    events = []
    assert not metrics.is_enabled()
    metrics.enable(events.append)
    with metrics.measure("load", table="t") as event:
        event["rows"] = 4
    with pytest.raises(KeyError), metrics.measure("fail"):
        raise KeyError("cell value")
    double = metrics.instrumented(lambda x: x * 2)
    assert double([1]) == [1, 1]
    metrics.disable()
    with metrics.measure("unseen"):
        pass
    ok, failed, called = events
    assert ok["status"] == "ok" and ok["rows_per_second"] > 0 and ok["table"] == "t"
    assert failed["status"] == "error" and failed["error"] == "KeyError" and "cell value" not in str(failed)
    assert called["rows_out"] == 2 and metrics.row_count(3) is None and metrics.row_count(pa.table({"a": [1]})) == 1


def test_operators_are_instrumented(spark, sales):
    events = []
    metrics.enable(events.append)
    try:
        aggregate(sales, [], [("weight", "sum", "s")])
        with pytest.raises(UnknownColumn):
            drop_duplicates(sales, ["nope"])
        table, seen = metrics.counted(sales)
        with metrics.measure("write") as event:
            table.write.format("noop").mode("overwrite").save()
            event["rows"] = seen.get["rows"]
    finally:
        metrics.disable()
    assert [(e["function"], e["status"], e.get("rows")) for e in events] == [("aggregate", "ok", None), ("drop_duplicates", "error", None), ("write", "ok", 6)]
    assert events[0]["group_by"] == [] and events[0]["aggregation_count"] == 1 and events[0]["rows_in"] is None
    assert events[1]["columns"] == ["nope"] and events[1]["error"].startswith("UnknownColumn: no column")


def test_metrics_sinks(tmp_path, capsys):
    path = tmp_path / "events.jsonl"
    for sink in (str(path), "stdout"):
        metrics.enable(sink)
        with metrics.measure("f"):
            pass
        metrics.disable()
    assert path.read_text().count("\n") == 1 and '"function": "f"' in capsys.readouterr().out


def test_cpu_features(tmp_path):
    info = tmp_path / "cpuinfo"
    info.write_text("flags : sse4_2 avx2\n")
    found = cpu_features(str(info))
    assert found.sse42 and found.avx2 and not found.avx512f
    assert isinstance(cpu_features("/nowhere"), CpuFeatures)


def test_tables(spark):
    tables = read_tables(spark, SF, ["region", "nation"])
    assert tables["region"].count() == 5
    batch = collect_as_record_batch(tables["nation"].repartition(4))
    assert batch.num_rows == 25 and to_arrow_schema(tables["nation"]).names == batch.schema.names
    assert collect_as_record_batch(tables["nation"].where("false")).num_rows == 0
    assert map_in_arrow(tables["region"], lambda batches: batches, tables["region"].schema).count() == 5


def test_streams(spark, tmp_path):
    tables = read_tables(spark, SF, ["events"])
    with pytest.raises(ConfigError):
        drop_duplicates_within(tables["events"], ["user_id"], "ts", "1 hour")
    tables["events"].limit(100).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(tables["events"].schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    shaped = clean_with_preset(hash_rows(drop_duplicates_within(stream, ["event_id"], "ts", "1 hour"), ["event_id"]), "event_type", "digits_only")
    query = shaped.writeStream.format("memory").queryName("shaped").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("shaped").count() == 100


def test_a_session_without_ansi_is_refused(spark, sales):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(ConfigError):
            aggregate(sales, [], [("weight", "sum", "s")])
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
