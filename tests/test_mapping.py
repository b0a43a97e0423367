"""Mapping semantics, both modes, and plans under skew."""

import json
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordflow.operators import mapping as m
from recordflow.operators import validation as v
from recordflow.operators.mapping import Rule
from recordflow.operators.schema import target


def flat(spark, rows, schema, rules, **options):
    df = spark.createDataFrame(rows, schema)
    return [r.asDict() for r in m.map_wide_flat(df, rules, ["id"], **options).orderBy("id").collect()]


def test_wide_slots_are_values_or_column_names(spark):
    rules = [Rule("sex", "s", "Male", ("M", "X"))]
    rows = [(1, "M", None), (2, "Male", "q"), (3, "X", "q"), (4, "X", None), (5, None, "q")]
    intended = flat(spark, rows, "id long, s string, X string", rules)
    assert [r["sex"] for r in intended] == ["Male", "Male", "Male", "Male", None]
    literal = flat(spark, rows, "id long, s string, X string", rules, compat="literal")
    assert [r["sex"] for r in literal] == [None, "Male", "Male", None, None]


def test_wide_compares_text_forms(spark):
    rules = [Rule("b", "b", "True"), Rule("d", "d", "10000000.0"), Rule("n", "n", "1"), Rule("e", "e", "1e+16")]
    rows = [(1, True, 1e7, 1, 1e16), (2, False, float("nan"), 2, 1.5)]
    got = flat(spark, rows, "id long, b boolean, d double, n int, e double", rules)
    assert (got[0]["b"], got[0]["d"], got[0]["n"], got[0]["e"]) == ("True", "10000000.0", "1", "1e+16")
    assert all(got[1][c] is None for c in "bdne")


def test_nan_counts_as_missing(spark):
    got = flat(spark, [(1, float("nan")), (2, 0.00005)], "id long, d double", [Rule("d", "d"), Rule("j", "d"), Rule("j", "id")])
    assert got[0]["d"] is None and got[0]["j"] == "1"
    assert got[1]["d"] == "5e-05" and json.loads(got[1]["j"]) == ["5e-05", "2"]


def test_method_is_that_of_the_first_rule_and_blank_rules_do_not_match(spark):
    rules = [Rule("a", "x", method="first"), Rule("a", "y", method="join_semicolon"), Rule("z", "", "T")]
    got = flat(spark, [(1, "p", "q"), (2, None, "q")], "id long, x string, y string", rules)
    assert [r["a"] for r in got] == ["p", "q"]
    assert [r["z"] for r in got] == [None, None]


def test_overlapping_targets_keep_both_values(spark):
    rules = [Rule("a", "x", "P", ("1", "2")), Rule("a", "x", "Q", ("2", "3"))]
    got = flat(spark, [(1, "1"), (2, "2"), (3, "3")], "id long, x string", rules)
    assert [r["a"] for r in got] == ["P", '["P","Q"]', "Q"]


def test_leaf_and_parent_path_is_rejected():
    with pytest.raises(ValueError, match="both a field and a parent"):
        m.by_field([Rule("a", "x"), Rule("a::b", "y")])


def test_rules_from_table():
    row = {"pydantic_field": "f", "pydantic_type": "str", "multiValue_handling_method": "first", "pydantic_value": None,
           "Observation_ColName": "c", "Observation_Value": "1", "Observation_Value2": "", "Observation_Value3": "3"}
    assert m.rules_from_table([row]) == [Rule("f", "c", "", ("1", "3"), "first", "str")]


LONG = "id long, name string, value string, ord long"
RULES = [
    Rule("first", "a", method="first"), Rule("all", "a", method="collect_all"), Rule("all", "b"),
    Rule("joined", "b", method="join_semicolon"), Rule("flag", "c", "True", ("yes",)), Rule("never", "c", "True"),
]


def brute_long(rows, rules):
    """Nested loops over ids, fields and rules."""
    out = {}
    for key in sorted({r[0] for r in rows if r[0] is not None}):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[3])
        record = {}
        for path, group in m.by_field(rules).items():
            values = []
            for _, rule in group:
                for _, name, value, _ in mine:
                    if not rule.column or name != rule.column or value is None:
                        continue
                    if not rule.value:
                        values.append(value)
                    elif value in rule.slots:
                        values.append(rule.value)
            values = list(dict.fromkeys(values))
            method = group[0][1].method
            if len(values) > 1:
                cell = values[0] if method == "first" else ";".join(values) if method == "join_semicolon" else json.dumps(values, separators=(",", ":"))
            else:
                cell = values[0] if values else None
            record[path] = cell
        out[key] = record
    return out


def hot_rows():
    """One id holds most rows; values repeat and clash across rules; some ids never match."""
    rows = [(1, "a" if i % 2 else "b", f"v{(i * 7) % 400}", 100_000 - i) for i in range(3_000)]
    rows += [(k, "abc"[k % 3], "yes" if k % 2 else f"w{k % 5}", k) for k in range(2, 300)]
    rows += [(500, "zzz", "1", 1), (None, "a", "1", 2), (501, "a", None, 3)]
    return rows


def test_long_equals_nested_loops_under_skew(spark):
    rows = hot_rows()
    got = m.map_long_flat(spark.createDataFrame(rows, LONG), "id", "name", "value", "ord", RULES)
    found = {r["id"]: {k: x for k, x in r.asDict().items() if k not in ("id", "record_part")} for r in got.collect()}
    assert found == brute_long(rows, RULES)


def test_long_lists_go_on_in_parts(spark):
    rows = hot_rows()
    source = spark.createDataFrame(rows, LONG)
    flat = m.map_long_flat(source, "id", "name", "value", "ord", RULES, part_values=7).collect()
    parts = defaultdict(list)
    for r in sorted(flat, key=lambda r: r["record_part"]):
        parts[r["id"]].append(r)
    assert len(parts[1]) > 20
    for key, expected in brute_long(rows, RULES).items():
        mine = parts[key]
        assert [r["record_part"] for r in mine] == list(range(len(mine)))
        for path, cell in expected.items():
            cells = [r[path] for r in mine if r[path] is not None]
            if len(mine) == 1 or path == "first":
                assert cells == ([] if cell is None else [cell])
            elif path == "all":
                values = [json.loads(c) if c.startswith("[") else [c] for c in cells]
                assert max(map(len, values)) <= 7 and sum(values, []) == json.loads(cell)
            elif path == "joined":
                assert ";".join(cells) == cell


def test_parts_are_checked_for_their_own_values(spark):
    source = spark.createDataFrame([(1, "a", f"v{i:03d}", i) for i in range(50)] + [(1, "b", "x", 99)], LONG)
    rules = [Rule("tags", "a", method="haveBoth"), Rule("s", "b", method="first")]
    checked = v.validate_rows(m.map_long(source, "id", "name", "value", "ord", rules, part_values=6), SCHEMA, ["record_id", "record_part"], raw=True)
    rows = sorted(checked.collect(), key=lambda r: r["record_part"])
    assert len(rows) == 9 and all(r["valid"] for r in rows)
    assert sum((r["record"]["tags"] for r in rows), []) == [f"v{i:03d}" for i in range(50)]
    assert sum((json.loads(r["data"])["tags"] for r in rows), []) == [f"v{i:03d}" for i in range(50)]
    assert [r["record"]["s"] for r in rows] == ["x"] + [None] * 8


def test_one_verdict_for_all_parts(spark):
    """A bad value in a late part, and in a single part; a good record of several parts stays whole."""
    rows = [(1, "a", str(i), i) for i in range(20)] + [(1, "a", "bad", 20)] + [(2, "a", str(i), i) for i in range(20)]
    rows += [(3, "a", "1", 0), (4, "a", "bad", 0), (5, "b", "x", 0), (6, "a", "bad", -1)] + [(6, "a", str(i), i) for i in range(20)]
    schema = T.StructType([target("vals", "int", many=True, required=True), target("s", "str")])
    rules = [Rule("vals", "a"), Rule("s", "b", method="first")]
    mapped = m.map_long(spark.createDataFrame(rows, LONG), "id", "name", "value", "ord", rules, part_values=3)
    checked = v.validate_rows(mapped, schema, ["record_id"], raw=True)
    good = [(r["record_id"], json.loads(r["record_json"])["vals"]) for r in v.records_json(checked, ["record_id", "record_part"]).orderBy("record_id", "record_part").collect()]
    assert {k for k, _ in good} == {2, 3} and sum((x for k, x in good if k == 2), []) == list(range(20))
    failed = sorted((r["row_identifier"], r["error"]) for r in v.quarantine(checked, F.col("record_id")).collect())
    assert failed == [(1, "vals: int_parsing"), (4, "vals: int_parsing"), (5, "vals: list_type"), (6, "vals: int_parsing")]
    data = defaultdict(list)
    for r in v.quarantine_data(checked, F.col("record_id")).orderBy("record_part").collect():
        data[r["row_identifier"]] += json.loads(r["data"]).get("vals") or []
    assert data[1] == [str(i) for i in range(20)] + ["bad"] and data[6] == ["bad"] + [str(i) for i in range(20)]
    assert {len(r["errors"]) for r in checked.where("record_id = 1").collect()} == {1}


DEEP = T.StructType([
    T.StructField("items", T.ArrayType(T.StructType([
        target("a", "str", required=True), target("n", "int"), target("tags", "str", many=True),
        T.StructField("parts", T.ArrayType(T.StructType([target("x", "float", required=True), target("k", "str", options=["p", "q"])]))),
    ])), False),
    target("note", "str"),
])


def test_lists_of_records_from_indexed_columns(spark):
    names = ["id", "items::0::a", "items::0::n", "items::0::parts::0::x", "items::0::parts::2::x", "items::0::parts::2::k", "items::3::a", "items::10::n"]
    rows = [(1, "u", "5", "1.5", "2", "q", None, None), (2, None, None, None, None, None, "v", None), (3, None, None, None, None, None, None, None),
            (4, "u", "x", "y", None, "z", "w", "7")]
    mapped = spark.createDataFrame(rows, ", ".join(f"`{n}` {'int' if n == 'id' else 'string'}" for n in names))
    got = {r["id"]: r.asDict(recursive=True) for r in v.validate_rows(mapped, DEEP, ["id"]).collect()}
    first = {"a": "u", "n": 5, "tags": None, "parts": [{"x": 1.5, "k": None}, {"x": 2.0, "k": "q"}]}
    assert got[1]["valid"] and got[1]["record"]["items"] == [first]
    assert got[2]["valid"] and got[2]["record"]["items"] == [{"a": "v", "n": None, "tags": None, "parts": None}]
    assert got[3]["error"] == "items: list_type" and got[3]["record"]["items"] is None
    assert got[4]["error"] == (
        "items::0::n: int_parsing; items::0::parts::0::x: float_parsing; items::0::parts::2::x: float_type; items::0::parts::2::k: enum; items::10::a: missing")
    nested = v.nest_paths(mapped.select("id"), DEEP, ["id"]).first()["record"]
    assert nested["items"] is None
    missing = v.validate_rows(mapped.select("id"), DEEP, ["id"]).first()
    assert missing["error"] == "items: missing"


def test_lists_of_records_in_answers(spark):
    texts = ['{"items":[{"a":"u","parts":[{"x":1},{"x":"2.5","k":"p"}],"tags":["t"]},{"a":"v","parts":[]}]}', '{"items":[]}', '{"items":null}', "{}",
             '{"items":[{"a":1,"parts":[{"x":"no","k":"r"},null,[]]}, 7]}', '{"items":{"a":"u"},"note":"n"}', '{"items":[{"a":"u","tags":"t"}]}', "no json", None]
    results = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "id int, raw_response string, error string")
    from recordflow.operators import extraction
    got = {r["id"]: r for r in extraction.parse_generation(results, DEEP, ["id"]).collect()}
    assert json.loads(got[0]["parsed_response"]) == {
        "items": [{"a": "u", "tags": ["t"], "parts": [{"x": 1.0}, {"x": 2.5, "k": "p"}]}, {"a": "v", "parts": []}]}
    assert json.loads(got[1]["parsed_response"]) == {"items": []}
    assert [got[i]["error"] for i in (2, 3)] == ["items: list_type"] * 2
    assert got[4]["error"] == (
        "items::0::a: string_type; items::0::parts::0::x: float_parsing; items::0::parts::0::k: enum; items::0::parts::1: model_type; "
        "items::0::parts::2: model_type; items::1: model_type")
    assert got[5]["error"] == "items: list_type" and got[6]["error"] == "items::0::tags: list_type"
    assert got[7]["error"] == got[8]["error"] == "invalid JSON" and not got[8]["parsing_success"]


def test_negative_and_large_orders_keep_their_place(spark):
    rows = [(1, "a", "late", 2**62), (1, "a", "early", -(2**62)), (1, "b", "other", -5)]
    got = m.long_candidates(spark.createDataFrame(rows, LONG), "id", "name", "value", "ord", RULES)
    places = {(r["field"], r["value"]): (r["rule_ord"], r["row_ord"]) for r in got.collect()}
    assert places[("all", "late")] == (1, 2**62) and places[("all", "early")] == (1, -(2**62)) and places[("all", "other")] == (2, -5)


def test_long_plan_filters_at_the_scan_and_combines_before_the_shuffle(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    df = m.long_candidates(events, "user_id", "event_type", "props", "event_id", [Rule("f", "view")])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "In(event_type" in plan or "EqualTo(event_type,view)" in plan
    assert "partial_min" in plan and "SortAggregate" not in plan and "BroadcastHashJoin" in plan


def test_wide_plan_has_no_shuffle_or_join(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plan = m.map_wide_flat(orders, [Rule("a", "o_orderstatus", "F"), Rule("b", "o_custkey")], ["o_orderkey"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Join" not in text and "o_totalprice" not in text


SCHEMA = T.StructType([
    target("s", "str", required=True), target("i", "int"), target("tags", "str", many=True),
    target("opt", T.StructType([target("need", "int", required=True), target("x", "str")])),
])


def check(spark, rows, ddl, rules, **options):
    mapped = m.map_wide(spark.createDataFrame(rows, ddl), rules, ["id"])
    return [r.asDict(recursive=True) for r in v.validate_rows(mapped, SCHEMA, ["id"], **options).orderBy("id").collect()]


def test_validation_kinds(spark):
    rules = [Rule("s", "n"), Rule("i", "t"), Rule("tags", "t"), Rule("opt::x", "t")]
    got = check(spark, [(1, 5, "5.5")], "id long, n int, t string", rules)[0]
    assert got["error"] == "s: string_type; i: int_parsing; opt::need: missing"
    assert got["record"]["tags"] == ["5.5"] and not got["valid"]
    literal = check(spark, [(1, 5, "5")], "id long, n int, t string", rules, compat="literal")[0]
    assert "tags: list_type" in literal["error"]


def test_optional_struct_without_values_is_null_or_kept(spark):
    rules = [Rule("s", "t"), Rule("opt::need", "n")]
    ok = check(spark, [(1, None, "a")], "id long, n int, t string", rules)[0]
    assert ok["valid"] and ok["record"]["opt"] is None
    kept = check(spark, [(1, None, "a")], "id long, n int, t string", rules, compat="literal")[0]
    assert kept["error"] == "opt::need: int_type" and kept["record"]["opt"] == {"need": None, "x": None}


def test_several_values_on_a_scalar_field_fail(spark):
    got = check(spark, [(1, "a", "b")], "id long, x string, y string", [Rule("s", "x"), Rule("s", "y")])[0]
    assert got["error"] == "s: string_type"


def test_valid_and_quarantined_rows_add_up(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    mapped = m.map_wide(orders, [Rule("s", "o_orderstatus"), Rule("i", "o_totalprice")], ["o_orderkey"])
    checked = v.validate_rows(mapped, SCHEMA, ["o_orderkey"], raw=True)
    good = v.records_json(checked, ["o_orderkey"]).count()
    bad = v.quarantine(checked, F.col("o_orderkey")).count()
    assert good + bad == orders.count() and bad > 0


def test_inject_id_prefers_the_id_name_then_patient_id(spark):
    source = spark.createDataFrame([(7, "a", "x", 1)], LONG)
    schema = T.StructType([target("id", "int"), target("patient_id", "int")])
    mapped = m.map_long(source, "id", "name", "value", "ord", [Rule("other", "a")])
    one = v.validate_rows(v.inject_id(mapped, schema, "id"), schema, []).first()["record"]
    assert one["id"] == 7 and one["patient_id"] is None
    mapped = m.map_long(source, "id", "name", "value", "ord", [Rule("id", "")])
    two = v.validate_rows(v.inject_id(mapped, schema, "id"), schema, []).first()["record"]
    assert two["id"] is None and two["patient_id"] == 7
