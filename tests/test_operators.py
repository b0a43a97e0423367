"""Golden cases, traps and brute-force comparisons of the other operators."""

import json
import math
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordflow.functions import text as t
from recordflow.operators import chat, cost, documents, extraction, flatten, profiling, responses, runs, sampling, schema, scoring, store
from recordflow.operators.schema import target
from recordflow.plans import schema as schema_plans
from recordflow.plans import shape as shape_plans
from recordflow.runtime import cut_lineage, distributed_rank, scratch_path, shared_dir
from recordflow.sources import files


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# Text forms and casts

def test_double_text_is_python_repr(spark):
    rng = random.Random(3)
    values = [1.0, 0.0, 1e7, 1e15, 9999999999999998.0, 1e16, 1e-4, 1e-5, 1.5e-7, math.inf, -math.inf]
    values += [round(rng.uniform(-1e12, 1e12), 3) for _ in range(500)]
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", t.double_text(F.col("x")).alias("s"))
    assert all(r["s"] == repr(r["x"]) for r in got.collect())


def test_title_restarts_after_every_non_letter(spark):
    got = spark.createDataFrame([("o'neil 3d",)], "s string").select(t.title_text(F.col("s")).alias("s")).first()["s"]
    assert got == "O'Neil 3D"


def test_lax_casts_follow_the_record_library(spark):
    pydantic = pytest.importorskip("pydantic")
    texts = ["5", " 5 ", "5.0", "1_000", "1__0", "+5", "5.5", "", "True", "1e3", " 1.5 ", "inf", ".5", "5e", "t", "YES", "On", "0", " true", "\t5\n"]
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    got = df.select("s", *[t.lax_cast(F.col("s"), d).alias(n) for n, d in schema.SCALARS.items()]).collect()
    for row in got:
        for name, kind in (("int", int), ("float", float), ("bool", bool)):
            try:
                expected = pydantic.TypeAdapter(kind).validate_python(row["s"])
            except pydantic.ValidationError:
                expected = None
            assert row[name] == expected, (row["s"], name)


def test_strict_json_reads_the_whole_text(spark):
    texts = ['{"a":1}', "[1] and [2]", "1,2", '1,"b":2', "1] x", "", " null ", '"s"']
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    got = [r[0] for r in df.select(F.to_json(t.strict_json(F.col("s")))).collect()]
    assert got == ['{"a":1}', None, None, None, None, None, "null", '"s"']


# Schemas and rules

def test_type_unwrapping(spark):
    cases = {
        "str": ("str", False, False), "Optional[List[Grade]]": ("Grade", True, True), "List[Optional[int]]": ("int", True, True),
        "int | None": ("int", True, False), "None | int": ("int", True, False), "Union[None, float]": ("float", True, False),
        "Union[str, int]": ("str", False, False), "Literal['a', None]": ("str", False, False), "Dict[str, int]": ("Dict", False, False),
    }
    df = spark.createDataFrame([(k,) for k in cases], "field_type string")
    for r in schema.resolve_field_type(df).collect():
        assert (r["base_type"], r["nullable"], r["is_list"]) == cases[r["field_type"]], r


def test_literal_paths_hide_optional_lists_and_recursion_is_an_error(spark):
    fields = spark.createDataFrame(
        [(1, "M", 1, "a", "Optional[List[E]]"), (1, "M", 2, "b", "List[N]"), (1, "N", 1, "c", "int")],
        "schema_id long, parent_class string, ord long, name string, field_type string",
    )
    main = spark.createDataFrame([(1, "M")], "schema_id long, main_class string")
    literal = {r["path"]: r["leaf_type"] for r in schema.schema_paths(fields, main, literal=True).collect()}
    assert literal == {"a": "List", "b::c": "int"}
    loop = spark.createDataFrame([(1, "M", 1, "a", "M")], fields.schema)
    with pytest.raises(ValueError, match="levels"):
        schema.schema_paths(loop, main, max_depth=3)


def test_struct_walk_matches_declaration_order():
    nested = T.StructType([target("z", "str"), target("a", T.StructType([target("b", "int", many=True)]))])
    assert [p for p, _ in schema.leaves(nested)] == ["z", "a::b"]


# Flattening

PERSON = {"name": "John Doe", "address": {"street": "123 Main St", "city": "New York"}, "skills": ["Python", "Data Analysis"]}


def test_flatten_person(spark):
    df = spark.createDataFrame([(0, json.dumps(PERSON))], "row_index long, doc string")
    got = {r["path"]: r["value"] for r in flatten.flatten_paths(df, "doc", ["row_index"]).collect()}
    expected = {"name": "John Doe", "address::street": "123 Main St", "address::city": "New York", "skills::0": "Python", "skills::1": "Data Analysis"}
    assert got == expected
    wide = flatten.flatten_wide(df, "doc", ["row_index"]).first().asDict()
    assert {k: x for k, x in wide.items() if k != "row_index"} == expected


def test_flatten_traps(spark):
    docs = ['{"a":{},"b":[],"c":null,"d":{"0":"key"},"e":[[1,[2]]]}', "[1,2]", "not json", "7"]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, doc string")
    got = {(r["id"], r["path"]): r["value"] for r in flatten.flatten_paths(df, "doc", ["id"]).collect()}
    assert got == {(0, "c"): None, (0, "d::0"): "key", (0, "e::0::0"): "1", (0, "e::0::1::0"): "2", (1, "0"): "1", (1, "1"): "2"}
    dotted = flatten.flatten_paths(df.where("id = 0"), "doc", ["id"], sep=".").collect()
    assert "e.0.1.0" in {r["path"] for r in dotted}
    with pytest.raises(Exception, match="nesting exceeds"):
        flatten.flatten_paths(df, "doc", ["id"], max_depth=2).collect()


# Profiles

def test_profiles_equal_brute_force(spark):
    rng = random.Random(5)
    data = [(i, rng.choice("abcde"), str(rng.randint(0, 2 if i < 2500 else 50)), float(i), rng.choice([None, True])) for i in range(3_000)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "ord long, name string, value string, many double, few boolean").repartition(6)
    ordered = sorted(data)
    long = {r["observation"]: r for r in profiling.profile_long(df, "name", "value", "ord").collect()}
    names = list(dict.fromkeys(r[1] for r in ordered))
    assert [n for n, _ in sorted(long.items(), key=lambda x: x[1]["position"])] == names
    for n in names:
        values = [r[2] for r in ordered if r[1] == n]
        assert json.loads(long[n]["unique_values"]) == list(dict.fromkeys(values))[:10]
        assert json.loads(long[n]["sample"]) == values[:3]
    wide = {r["column"]: r for r in profiling.profile_wide(df, "ord").collect()}
    assert json.loads(wide["many"]["unique_values"]) == [str(float(i)) for i in range(10)]
    few = [None if r[4] is None else "True" for r in ordered]
    assert json.loads(wide["few"]["unique_values"]) == list(dict.fromkeys(few))
    assert json.loads(wide["few"]["sample"]) == few[:3]


def test_profiles_of_ties_nulls_and_many_names(spark):
    rng = random.Random(6)
    data = [(rng.choice([None, *range(300)]), rng.choice([None, *map(str, range(400))]), rng.choice([None, "x", "y", str(rng.random())])) for _ in range(6_000)]
    df = spark.createDataFrame(data, "ord int, name string, value string").repartition(5)

    def first(v):
        return v is not None, v

    for r in profiling.profile_long(df, "name", "value", "ord").collect():
        rows = sorted(((o, v) for o, n, v in data if n == r["observation"]), key=lambda x: (first(x[0]), first(x[1])))
        assert json.loads(r["sample"]) == [v for _, v in rows][:3]
        assert json.loads(r["unique_values"]) == list(dict.fromkeys(v for _, v in rows))[:10]
    plan = profiling._summary(df.selectExpr("name AS key", "value", "ord AS place"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    assert profiling.profile_wide(df.limit(0), "ord").count() == 0 and profiling.profile_long(df.limit(0), "name", "value", "ord").count() == 0


def test_list_answers_by_their_json_kind(spark):
    answers = T.StructType([target("tags", "str", required=True, many=True), target("opt", "str", many=True), target("ns", "int", many=True)])
    cases = {
        '{"tags":["a"],"opt":"scalar"}': "opt: list_type", '{"tags":["a",null]}': "tags: string_type", '{"tags":[1,2]}': "tags: string_type",
        '{"tags":[]}': None, '{"tags":["a"],"opt":null,"ns":[1,2]}': None, '{"tags":"a"}': "tags: list_type", '{}': "tags: list_type",
        '{"tags":["a"],"ns":[1,null]}': "ns: int_type", '{"tags":["a"],"ns":["x"]}': "ns: int_parsing", "nothing": "invalid JSON",
    }
    df = spark.createDataFrame([(k, None) for k in cases], "raw_response string, error string")
    got = {r["raw_response"]: r for r in extraction.parse_generation(df, answers, ["raw_response"]).collect()}
    assert {k: r["error"] for k, r in got.items()} == cases
    assert got['{"tags":[]}']["parsed_response"] == '{"tags":[]}'
    assert got['{"tags":["a"],"opt":null,"ns":[1,2]}']["parsed_response"] == '{"tags":["a"],"ns":[1,2]}'


def test_profile_of_a_null_name(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "a", "y"), (3, None, "z")], "ord long, name string, value string")
    got = {r["observation"]: (r["position"], json.loads(r["unique_values"])) for r in profiling.profile_long(df, "name", "value", "ord").collect()}
    assert got == {None: (1, ["x", "z"]), "a": (2, ["y"])}


def test_evidence_offsets_are_those_of_the_text(spark):
    rows = [("İİ abc", "ABC"), ("x \\E [a", "\\e [A"), ("a😀b Q", "q"), ("abc", ""), ("abc", "d"), (None, "a"), ("a", None)]
    got = [tuple(r)[2:] for r in documents.evidence_spans(spark.createDataFrame(rows, "text string, value string").coalesce(1), "text", "value").collect()]
    assert got == [(3, 6), (2, 7), (4, 5)] + [(None, None)] * 4


def test_recommendations_show_for_valid_analyses_only(spark):
    def analysis(*priorities):
        recs = [{"type": "general", "priority": p, "description": "d", "reason": "r", "example": "e"} for p in priorities]
        return json.dumps({"recommendations": recs, "general_feedback": "f"})

    df = spark.createDataFrame([(1, analysis("low", "high")), (2, analysis("low", "High"))], "id long, advice string")
    got = responses.recommendations_by_priority(responses.normalize_recommendations(df, "advice"), ["id"]).collect()
    assert [(r["id"], r["priority"], r["reason"], r["example"]) for r in got] == [(1, "high", "r", "e"), (1, "low", "r", "e")]


def test_distributed_rank(spark):
    df = spark.range(1_000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = distributed_rank(df, ["k"], "n").orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(1, 1_001))


# Responses

def test_synonyms_and_priorities(spark):
    recs = [{"type": k, "description": "d", "reason": "r", "priority": "High"} for k in responses.TYPE_SYNONYMS]
    recs += [{"description": "d", "reason": "r", "priority": "urgent"}, {"type": "Zzz", "description": "d", "reason": "r"}]
    df = spark.createDataFrame([(1, json.dumps({"recommendations": recs}))], "id long, j string")
    normal = responses.normalize_recommendations(df, "j")
    out = normal.first()["analysis"]
    assert [r["type"] for r in out["recommendations"]] == [*responses.TYPE_SYNONYMS.values(), None, "general"]
    assert [r["priority"] for r in out["recommendations"]][-3:] == ["High", "urgent", "medium"]
    assert out["general_feedback"] == responses.DEFAULT_FEEDBACK
    assert not responses.valid_analysis(normal).first()["valid"]


def test_analyses_and_schemas_by_json_kind(spark):
    rec = {"type": "general", "priority": "low", "description": "d", "reason": "r"}
    good = {"recommendations": [rec], "general_feedback": "f"}
    cases = [
        (good, True), ({**good, "missing_information": ["x"]}, True), ({**good, "missing_information": "x"}, False),
        ({**good, "missing_information": [1]}, False), ({**good, "missing_information": None}, False), ({**good, "general_feedback": 7}, False),
        ({**good, "recommendations": [{**rec, "description": 5}]}, False), ({**good, "recommendations": [{**rec, "example": None}]}, True),
        ({**good, "recommendations": "x"}, False), ({**good, "recommendations": []}, True), ({"general_feedback": "f"}, False), ([], False), (None, False),
    ]
    df = spark.createDataFrame([(i, json.dumps(a) if a is not None else None) for i, (a, _) in enumerate(cases)], "id long, j string")
    got = {r["id"]: r["valid"] for r in responses.valid_analysis(responses.normalize_recommendations(df, "j")).collect()}
    assert got == {i: ok for i, (_, ok) in enumerate(cases)}

    field = {"name": "f", "field_type": "str", "parent_class": "M", "description": "x"}
    schema = {"main_class": "M", "classes": [{"name": "M", "description": "m"}], "fields": [field]}
    options = [{"value": "A", "label": "x"}, "red_hue"]
    cases = [
        (schema, True), ({**schema, "fields": [{**field, "enum_values": options}]}, True), ({**schema, "fields": [{**field, "enum_values": [1]}]}, False),
        ({**schema, "fields": [{**field, "enum_values": [{"value": 1}]}]}, False), ({**schema, "fields": [{**field, "name": 3}]}, False),
        ({**schema, "fields": [{**field, "is_optional": "no", "default_value": 3}]}, True), ({**schema, "fields": [{**field, "is_optional": [1]}]}, False),
        ({**schema, "enums": [{"name": "E", "description": "e", "values": ["a"]}]}, True), ({**schema, "enums": [{"name": "E", "values": ["a"]}]}, False),
        ({**schema, "classes": None}, False), ({**schema, "enums": None}, False),
    ]
    answers = [(i, "{}", json.dumps({"is_optimized": True, "reasoning": "r", "optimized_schema": a})) for i, (a, _) in enumerate(cases)]
    out = responses.accept_optimized(spark.createDataFrame(answers, "id long, original string, answer string"), "original", "answer").collect()
    assert {r["id"]: r["is_optimized"] for r in out} == {i: ok for i, (_, ok) in enumerate(cases)}
    kept = json.loads(next(r["final_schema"] for r in out if r["id"] == 1))["fields"][0]["enum_values"]
    assert kept == [{"value": "A", "label": "x"}, {"name": "RED_HUE", "description": "Red Hue"}]


# Conversations

def test_transcript_parts_join_to_the_whole(spark):
    turns = [(1, i, "user", f"t{i}") for i in range(25)] + [(2, 0, "assistant", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    parts = chat.transcript(df, part_turns=10).orderBy("conv_id", "part").collect()
    assert len(parts) == 4
    assert "\n\n".join(p["transcript"] for p in parts if p["conv_id"] == 1) == "\n\n".join(f"USER: t{i}" for i in range(25))


def test_messages_repeat_the_last_user_turn_only_when_asked(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c")], "conv_id long, turn long, role string, text string")
    once = [r["content"] for r in chat.build_messages(df, "sys").orderBy("position").collect()]
    twice = [r["content"] for r in chat.build_messages(df, "sys", dedupe=False).orderBy("position").collect()]
    assert once == ["sys", "a", "b", "c"] and twice == once + ["c"]
    assert chat.eligible_conversations(df).count() == 0 and chat.eligible_conversations(df, force=True).count() == 3


# Costs

def test_shadowed_price_and_longest_match(spark):
    df = spark.createDataFrame([("gpt-4.1-mini",), ("GPT-4.1-Mini@east",), ("o3:x",), ("unknown",)], "model string")
    assert [r["price_key"] for r in cost.price_lookup(df).collect()] == ["gpt-4.1", "gpt-4.1", "o3", "default"]
    assert [r["price_key"] for r in cost.price_lookup(df, longest_match=True).collect()] == ["gpt-4.1-mini", "gpt-4.1-mini", "o3", "default"]


def test_breakdown_adds_up(spark):
    df = spark.createDataFrame([("a", "o3", 10, 20), ("b", "gpt-4o", 5, 5), ("a", "x", 1, 1)], "agent string, model string, prompt_tokens long, completion_tokens long")
    got = {r["agent"]: (r["cost"], r["calls"]) for r in cost.cost_breakdown(cost.call_cost(df)).collect()}
    assert got["Total"][1] == 3 and math.isclose(got["Total"][0], got["a"][0] + got["b"][0])


# Store

def test_upsert_keeps_the_latest_of_many_saves(spark):
    saves = [(i % 3, i, f"v{i}") for i in range(300)]
    df = spark.createDataFrame(saves, "row_index long, version long, values string")
    got = {r["row_index"]: r["values"] for r in store.upsert_extractions(df, df.limit(0)).collect()}
    assert got == {0: "v297", 1: "v298", 2: "v299"}


def test_unset_ids_fall_back(spark):
    df = spark.createDataFrame([(0, 0, ""), (1, 9, "x"), (2, None, None)], "row_index long, n long, s string")
    assert [r["id"] for r in store.assign_id(df, "row_index", "n").collect()] == ["row_1", "9", "row_3"]
    assert [r["id"] for r in store.assign_id(df, "row_index", "s").collect()] == ["row_1", "x", "row_3"]
    assert [r["id"] for r in store.assign_id(df, "row_index", "absent").collect()] == ["row_1", "row_2", "row_3"]


# Scores and runs

def test_scores_cover_the_no_information_case(spark):
    gold = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "a"), (5, "a")], "k long, f string")
    pred = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, None), (5, "b")], "k long, f string")
    r = scoring.score_fields(gold, pred, "k", ["f"]).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (1, 2, 2, 1) and r["accuracy"] == 0.4


def test_percentile_is_exact_with_a_hot_configuration(spark):
    rng = random.Random(9)
    data = [("hot", rng.randint(0, 90_000)) for _ in range(5_000)] + [("one", 7)] + [("few", x) for x in (5, 1999, 2000, 2001)]
    df = spark.createDataFrame(data, "config string, time_ms long").selectExpr("config", "true AS success", "time_ms", "1L AS tokens", "0.5D AS cost")
    got = {r["config"]: r["p95_time"] for r in runs.run_report(df, "config").collect()}
    for name in ("hot", "one", "few"):
        times = sorted(x for c, x in data if c == name)
        assert got[name] == times[math.ceil(len(times) * 0.95) - 1] / 1000


def test_iteration_delta_crosses_blocks_and_gaps(spark):
    steps = [i for i in range(0, 5_000, 3) if not 900 < i < 3_100]
    data = [("p", i, float((i * 31) % 17)) for i in steps] + [("q", 5, 1.0)]
    got = {(r["prompt"], r["iteration"]): r["previous_score"] for r in runs.iteration_delta(spark.createDataFrame(data, "prompt string, iteration long, score double"), "prompt", "iteration", "score").collect()}
    scores = [(i * 31) % 17 for i in steps]
    assert [got[("p", i)] for i in steps] == [None] + [float(x) for x in scores[:-1]] and got[("q", 5)] is None


def test_best_config_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("g", "b", 2), ("g", "a", 2), ("g", "c", 1)], "g string, c string, s long")
    r = runs.best_config(df, "g", "c", "s").first()
    assert (r["c"], r["best_score"]) == ("a", 2.0)


def test_cluster_sample_takes_the_nearest(spark):
    points = [(i, [float(i), 0.0], 0) for i in range(11)] + [(100, [5.0, 5.0], 1)]
    df = spark.createDataFrame(points, "id long, v array<double>, c int")
    got = [r["id"] for r in sampling.cluster_sample(df, "id", "v", "c", 3).where("c = 0").orderBy("rank").collect()]
    assert got == [5, 4, 6]


# Documents

def test_masking_is_stable_and_leaves_the_rest(spark):
    df = spark.createDataFrame([("mail a.b@c.de, a.b@c.de call +1 (555) 123-4567 id AB-12345678.",), ("plain",), (None,)], "t string")
    got = [r["masked"] for r in documents.pseudonymize(df, "t", "s").collect()]
    first = got[0].split()
    assert first[1].rstrip(",") == first[2] and first[2].startswith("[EMAIL_")
    assert "[PHONE_" in got[0] and got[0].endswith("].") and "555" not in got[0].replace(first[2], "")
    assert got[1] == "plain" and got[2] is None
    keys = rows(documents.pseudonym_keys(df, "t", "s"))
    assert {k["original"] for k in keys} == {"a.b@c.de", "+1 (555) 123-4567", "AB-12345678"} and all(k["token"] in got[0] for k in keys)


def test_html_to_text(spark):
    page = ("<html><head><title>A &amp; B</title><style>p{}</style></head><body><script>x('<p>')</script><header>Top</header>"
            "<p>caf&eacute; &#8364; &#x1F600; &amp;lt; &bogus;</p><!-- no -->\n<ul><li>one<li>t<b>w</b>o</ul></body>")
    r = documents.html_to_text(spark.createDataFrame([(page,)], "html string"), "html").first()
    assert r["title"] == "A & B"
    assert r["visible_text"] == "Top\ncafé € 😀 &lt; &bogus;\none\ntwo"


def test_phones_and_addresses_are_masked(spark):
    texts = ["555-123-4567", "(555) 123-4567", "+1 555 123 4567", "+44 20 7946 0958", "10.0.0.1", "1 (555) 123-4567", "+49-(0)30.123456", "x@y.org", "1234567"]
    kinds = ["PHONE"] * 4 + ["IP", "PHONE", "PHONE", "EMAIL", "ID"]
    clean = ["version 3.11.2 of 2024-05-06, 12 + 34, page 555-123", "a@b", "1.5 and 100.25", None]
    got = [r["masked"] for r in documents.pseudonymize(spark.createDataFrame([(f"call {t} now",) for t in texts] + [(t,) for t in clean], "t string"), "t", "s").collect()]
    assert [re.sub("_[0-9a-f]{12}", "", m) for m in got[:len(texts)]] == [f"call [{k}] now" for k in kinds] and got[len(texts):] == clean


def test_key_table_over_batches(spark):
    """Two hex digits, so that tokens collide: every token leads back to one text, known texts keep theirs."""
    first = spark.createDataFrame([(f"m{i}@x.org and m{i}@x.org",) for i in range(60)], "t string")
    second = spark.createDataFrame([(f"m{i}@x.org",) for i in range(30, 90)], "t string")
    one = documents.merge_keys(None, first, "t", "s", 0, digits=2)
    both = documents.merge_keys(one, second, "t", "s", 1, digits=2)
    old, new = ({r["original"]: r for r in k.collect()} for k in (one, both))
    assert len(old) == 60 and len(new) == 90 and all(new[k] == r for k, r in old.items())
    assert len({r["token"] for r in new.values()}) == 90 and any(r["is_long"] for r in new.values()) and new["m70@x.org"]["batch"] == 1
    assert documents.merge_keys(both, second, "t", "s", 2, digits=2).count() == 90
    long = next(r for r in new.values() if r["is_long"])
    masked = documents.pseudonymize(spark.createDataFrame([(long["original"],)], "t string"), "t", "s", keys=both).first()["masked"]
    assert masked == long["token"]


def test_html_states(spark):
    cases = {"<p title='a>b'>hi</p>&apos;": "hi\n'", '<div data-x="</div>" >a<br/>b': "a\nb", "a<!-- x > <p> -->b": "a b", "a<!-- open <p>z": "a",
             "1 < 2 > 0 <b>x</b>": "1 < 2 > 0 x", "<script>if (a<b) '</p>'</script>t": "t", "<script>open": "", "&NotEqualTilde;&fjlig;&nosuch;": "≂̸fj&nosuch;",
             "<!DOCTYPE html><?php x ?>k": "k", "<style>a</STYLE >b<TEMPLATE>c</template>": "b", '<a href="x" title="unclosed>y': "y", '<a href="x': '<a href="x',
             "<script>'<!--'</script>v<!--<script>-->w": "v w", "<scripture>s": "s"}
    df = spark.createDataFrame([(k,) for k in cases], "html string")
    got = {r["html"]: r["visible_text"] for r in documents.html_to_text(df, "html").collect()}
    assert {k: got[k] for k, v in cases.items() if re.sub(" +", " ", got[k]).strip() != v} == {}


def test_json_as_written(spark):
    docs = ['{"a":5.0,"b":1e2,"c":-0,"d":1.10E-07,"a":12345678901234567890.123}', '{"x":NaN,"y":[Infinity,-Infinity]}',
            '{"s":"1.0 \\\\","t":"q\\" 2","u\'v":"\\n3"}', "[01]", "[1.]", '{"a":1} 2', '{"a: 1}', "[-NaN]", "[1 2]", '["\\u0041", "é", true, null]',
            '{"long":"' + '\\n\\"' * 20_000 + '7"}', "NaN", "", None]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, doc string")
    got = {}
    for r in flatten.flatten_paths(df, "doc", ["id"]).collect():
        got.setdefault(r["id"], {})[r["path"]] = r["value"]
    assert got[0] == {"a": "12345678901234567890.123", "b": "1e2", "c": "-0", "d": "1.10E-07"}
    assert got[1] == {"x": "NaN", "y::0": "Infinity", "y::1": "-Infinity"}
    assert got[2] == {"s": "1.0 \\", "t": 'q" 2', "u'v": "\n3"} and got[9] == {"0": "A", "1": "é", "2": "true", "3": None}
    assert got[10]["long"] == '\n"' * 20_000 + "7" and set(got) == {0, 1, 2, 9, 10}
    wide = {r["id"]: r for r in flatten.flatten_wide(df, "doc", ["id"], ["a", "u'v", "y::1", "0"]).collect()}
    assert wide[0]["a"] == "12345678901234567890.123" and wide[2]["u'v"] == "\n3" and wide[1]["y::1"] == "-Infinity" and wide[9]["0"] == "A"
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"
    texts = spark.createDataFrame([(0, '[{"pydantic_field":1.50,"pydantic_type":NaN,"pydantic_type":"b","pydantic_value":{"n":2.0}}]'), (1, "x [1e2, 1.0] y")], "id int, s string")
    parsed = responses.parse_json_array(texts, "s")
    assert [r["parsed"] for r in parsed.orderBy("id").collect()][1] == "[1e2,1.0]"
    rule = responses.rules_from_responses(parsed, ["id"]).where("id = 0").first()
    assert (rule["pydantic_field"], rule["pydantic_type"], rule["pydantic_value"]) == ("1.50", "b", '{"n":2.0}')


def test_wide_form_of_many_paths(spark):
    rows = [(i, json.dumps({f"k{i}": {"a'\"b": i, "n": [None, 1.5]}, "same": "x"})) for i in range(400)] + [(400, "{}"), (401, "no"), (401, '{"same":null}')]
    df = spark.createDataFrame(rows, "id int, doc string")
    groups = flatten.flatten_groups(df, "doc", ["id"], width=500)
    assert [len(g.columns) for g in groups] == [502, 502, 203] and flatten.union_paths(df, "doc").count() == 1201
    first = {r["id"]: r for r in groups[0].where("id < 3").collect()}
    assert first[1]["k1::a'\"b"] == "1" and first[1]["k1::n::0"] is None and first[1]["k1::n::1"] == "1.5" and first[1]["k0::n::1"] is None
    assert all(g.count() == 403 for g in groups[:1])
    with pytest.raises(ValueError):
        flatten.flatten_wide(df, "doc", ["id"])


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_unify_labels_against_every_pair(spark, distance):
    """Short labels and values over few letters, so that every kind of edit and many ties occur; nulls and blanks."""
    rnd = random.Random(distance)
    labels = list(dict.fromkeys("".join(rnd.choice("abé") for _ in range(rnd.randint(0, 7))) for _ in range(60)))
    values = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(0, 9))) for _ in range(300)] + [None, " ", "!A?", "\U0001f600ab"]
    df = spark.createDataFrame([(i, s, "kept") for i, s in enumerate(values)], "norm int, s string, label_no string")
    got = {r["norm"]: (r["label"], r["match"], r["distance"]) for r in documents.unify_labels(df, "s", labels, distance).collect()}
    assert len(got) == len(values)
    for i, s in enumerate(values):
        if s is None:
            assert got[i] == (None, "none", None)
            continue
        norm = " ".join(re.findall(r"\w+", s.lower()))
        best = min((_edits(norm, label), n) for n, label in enumerate(labels))
        wanted = (labels[best[1]], "near" if best[0] else "exact", best[0]) if best[0] <= distance else (None, "none", None)
        assert got[i] == wanted, (s, got[i], wanted)


def test_unify_labels(spark):
    df = spark.createDataFrame([("stage II",), ("STAGE  ii!",), ("stage IIx",), ("other",)], "s string")
    got = [(r["label"], r["match"]) for r in documents.unify_labels(df, "s", ["Stage I", "Stage II"], 1).collect()]
    assert got == [("Stage II", "exact"), ("Stage II", "exact"), ("Stage II", "near"), (None, "none")]


# Extraction

def test_failures_become_rows(spark):
    def make_client():
        def client(texts):
            if "bad" in texts:
                raise RuntimeError("refused")
            return [json.dumps({"field1": x, "field2": "7"}) for x in texts]
        return client

    df = spark.createDataFrame([(i, "bad" if i == 3 else f"t{i}") for i in range(8)], "id long, text string")
    results = extraction.batch_extract(df, "text", ["id"], make_client, partitions=2)
    shape = T.StructType([target("field1", "str", required=True), target("field2", "int", required=True), target("field3", "str", many=True)])
    parsed = {r["id"]: r for r in extraction.parse_generation(results, shape, ["id"]).collect()}
    assert parsed[3]["error"] == "refused" and not parsed[3]["parsing_success"]
    assert json.loads(parsed[1]["parsed_response"]) == {"field1": "t1", "field2": 7}


def test_text_fields_take_json_strings_only(spark):
    df = spark.createDataFrame([(1, '{"field1": 5}', None), (2, "no json", None)], "id long, raw_response string, error string")
    got = {r["id"]: r["error"] for r in extraction.parse_generation(df, T.StructType([target("field1", "str", required=True)]), ["id"]).collect()}
    assert got == {1: "field1: string_type", 2: "invalid JSON"}


def test_pending_keeps_failed_and_new(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    results = spark.createDataFrame([(1, True), (2, False), (1, False)], "id long, ok boolean")
    assert {r["id"] for r in runs.resume_pending(docs, results, "id", "ok").collect()} == {2, 3}


# Files

CSV = 'a,b,c\n1,x,y\n2,"q, ""r""",\n3\n4,x,y,z\n5,x,y,\nNA,None,n/a\n6,"x,y"\n7,"a","b","c"\n'


def test_csv_files_of_different_headers(spark, tmp_path):
    """Columns by name, quoted line breaks, types over all rows, row numbers; long and blank lines, odd names, empty files."""
    texts = {"a 1.csv": 'i,t,f,b\n1,"x\ny",1.5,True\n\n2,z\n3,q,2,False,extra\n', "b.csv": '\ufefft,i,"new, col"\n"say ""hi""",7,NA\nw,,5\n',
             "c.csv": "i,t,f,b\n-4,NaN,1e3,true\n99999999999,k,inf,false\n", "d.csv": "", "e.csv": "i,t,f,b\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = files.read_csv_lenient(spark, str(tmp_path), infer=True, row_index="n").orderBy("n")
    assert dict(got.dtypes) == {"i": "bigint", "t": "string", "f": "double", "b": "boolean", "new, col": "bigint", "n": "bigint"}
    assert [tuple(r) for r in got.collect()] == [
        (1, "x\ny", 1.5, True, None, 0), (2, "z", None, None, None, 1), (7, 'say "hi"', None, None, None, 2), (None, "w", None, None, 5, 3),
        (-4, None, 1000.0, True, None, 4), (99999999999, "k", float("inf"), False, None, 5)]
    frame = pd.concat([pd.read_csv(p, on_bad_lines="skip", encoding="utf-8-sig") for p in sorted(tmp_path.iterdir()) if p.stat().st_size])
    assert [x for x in frame["t"].fillna("-")] == [r["t"] or "-" for r in got.collect()]
    (tmp_path / "none").mkdir()
    assert files.read_csv_lenient(spark, str(tmp_path / "none")).count() == 0


def test_row_numbers_over_many_splits(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    (tmp_path / "x.csv").write_text("v\n" + "".join(f"{i}\n" if i % 7 else f"{i},bad\n" for i in range(20_000)))
    (tmp_path / "y.csv").write_text("v\n" + "".join(f"{i}\n" for i in range(20_000, 21_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = files.read_csv_lenient(spark, str(tmp_path), row_index="n", infer=True)
        assert [tuple(r) for r in rows.orderBy("n").collect()] == [(x, n) for n, x in enumerate([i for i in range(21_000) if i % 7 or i >= 20_000])]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lenient_csv_equals_pandas(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(CSV)
    expected = pd.read_csv(path, on_bad_lines="skip", dtype=str)
    got = files.read_csv_lenient(spark, str(path)).toPandas()
    wanted = [tuple(None if pd.isna(x) else x for x in r) for r in expected.itertuples(index=False)]
    assert [tuple(None if pd.isna(x) else x for x in r) for r in got.itertuples(index=False)] == wanted


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.json").write_text('{"x": 3}')
    got = files.read_json_records(spark, str(tmp_path), T.StructType([T.StructField("x", T.LongType())]))
    assert sorted(r["x"] for r in got.collect()) == [1, 2, 3]
    (tmp_path / "c.json").write_text('"only text"')
    (tmp_path / "d.json").write_text("{broken")
    other = {r["file_name"]: r["text"] for r in files.read_json_other(spark, str(tmp_path)).collect()}
    assert other == {"c.json": '"only text"', "d.json": "{broken"}


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', None), (2, None, "z")], "k long, `p::x` string, y string")
    files.write_flat_csv(df.select("y", "k", "p::x"), str(tmp_path / "csv"), "k")
    text = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()[0]
    assert text == "k,y,p::x"
    back = files.read_csv_lenient(spark, str(tmp_path / "csv"))
    assert sorted(back.select("k", "`p::x`").collect()) == [("1", 'a "q", b'), ("2", None)]
    files.write_records_json(df, str(tmp_path / "json"))
    lines = [json.loads(x) for f in (tmp_path / "json").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted(lines, key=lambda x: x["k"]) == [{"k": 1, "p::x": 'a "q", b'}, {"k": 2, "y": "z"}]


# Runtime

def test_scratch_space_follows_the_session(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    df = cut_lineage(spark.range(10).where("id > 3"))
    assert df.count() == 6 and "Range" not in df._jdf.queryExecution().executedPlan().toString()


def test_nesting_of_any_depth(spark):
    deep = "".join(f'{{"k{i}":' for i in range(20)) + "1.5" + "}" * 20
    df = spark.createDataFrame([(1, deep), (2, '{"a": [1, null]}')], "id long, doc string")
    got = {(r["id"], r["path"]): r["value"] for r in flatten.flatten_paths(df, "doc", ["id"]).collect()}
    assert got == {(1, "::".join(f"k{i}" for i in range(20))): "1.5", (2, "a::0"): "1", (2, "a::1"): None}
    members = [("s", f"C{i}", 0, "next", f"C{i + 1}") for i in range(20)] + [("s", "C20", 999_999, "x", "int"), ("s", "C20", 1_000_000, "y", "int")]
    fields = spark.createDataFrame(members, "schema_id string, parent_class string, ord long, name string, field_type string")
    main = spark.createDataFrame([("s", "C0")], "schema_id string, main_class string")
    paths = [r["path"] for r in sorted(schema.schema_paths(fields, main).collect(), key=lambda r: r["sort_key"])]
    assert paths == ["next::" * 20 + "x", "next::" * 20 + "y"]
    loop = fields.unionByName(spark.createDataFrame([("s", "C20", 3, "z", "C18")], fields.schema))
    with pytest.raises(ValueError, match="refers to itself"):
        schema.schema_paths(loop, main)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_and_options_are_not_broadcast(spark, tmp_path):
    """One row of the file makes many option rows, which its size does not show."""
    spark.range(50).write.parquet(str(tmp_path / "ids"))
    ids = spark.read.parquet(str(tmp_path / "ids")).select(F.col("id").alias("schema_id"))
    enums = ids.select("schema_id", F.lit("Kind").alias("enum_name"), F.explode(F.array(*[F.lit(n).cast("bigint") for n in (1, 2, 3)])).alias("ord"))
    enums = enums.withColumn("value", F.concat(F.lit("v"), "ord"))
    rules = ids.select(
        "schema_id", F.lit("f").alias("pydantic_field"), F.lit("Kind").alias("pydantic_type"),
        F.when(F.col("schema_id") == 7, "no").otherwise("v2").alias("pydantic_value"), F.lit("c").alias("Observation_ColName"))
    checked = schema.validate_mapping(rules, enums.unionAll(enums), ["schema_id"])
    template = schema.mapping_template(ids.select("schema_id", F.lit("f").alias("path"), F.lit("Kind").alias("leaf_type"), F.lit("1").alias("sort_key")), enums)
    fields = ids.select("schema_id", F.lit("Top").alias("parent_class"), F.lit(1).cast("bigint").alias("ord"), F.lit("f").alias("name"), F.lit("Kind").alias("field_type"))
    paths = schema.schema_paths(fields, ids.select("schema_id", F.lit("Top").alias("main_class")))
    for df in (checked, template, paths, schema.mapping_monitor(checked)):
        assert "Broadcast" not in _plan(df)
    errors = {r["schema_id"]: r["mapping_error"] for r in checked.collect()}
    assert len(errors) == checked.count() == 50
    assert {k for k, e in errors.items() if e} == {7} and errors[7] == "unknown enum value: no"
    assert template.count() == 150 and paths.count() == 50


def test_definitions_are_parsed_once(spark, sf_dir):
    """A variant per document, not one per entry and option; options and documents without any stay as they are."""
    docs = [
        '{"fields":[{"name":"a","enum_values":["x_y",{"name":"N"},"{z"]},{"name":"b"}],"enums":[{"name":"E","values":["q","r"]}]}',
        '{"fields":[{"name":"a","enum_values":[]}]}', "no json", None,
    ]
    given = spark.range(4).select("id", F.element_at(F.array(*[F.lit(d) for d in docs]), (F.col("id") + 1).cast("int")).alias("doc"))
    normal = schema.normalize_enum_values(given, "doc")
    plan = normal._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parsejson") + plan.count("parse_json") == 1 and plan.count("from_json(structfield(main_class") == 1
    got = {r["id"]: r["schema"] for r in normal.collect()}
    named = [{"name": "X_Y", "description": "X Y"}, {"name": "N"}, {"name": "{Z", "description": "{Z"}]
    assert got[0]["fields"][0]["enum_values"] == named and got[0]["fields"][1]["enum_values"] is None
    assert [v["name"] for v in got[0]["enums"][0]["values"]] == ["Q", "R"]
    assert got[1]["fields"][0]["enum_values"] == [] and got[1]["enums"] is None
    assert got[2]["fields"] is None and got[3] is None
    assert "rebalance" in _plan(schema_plans.definition_json(spark, sf_dir)).lower()


def test_leaves_are_not_written_out_on_every_level(spark, sf_dir):
    docs = ['{"a":{"b":[null,{},[],"{}",[[1.0]]],"c":null},"d":"[]","e":true}', "7", "{}", "[]", "null", "no json", '["x",[null]]']
    given = spark.createDataFrame(list(enumerate(docs)), "id long, doc string")
    opened = flatten._opened(given.select("id", F.lit("").alias("path"), t.strict_json(F.col("doc"), as_written=True).alias("_v")), ["id"], "::", 8)
    assert opened._jdf.queryExecution().analyzed().toString().count("to_json") == 1
    got = {(r["id"], r["path"]): r["value"] for r in flatten.flatten_paths(given, "doc", ["id"]).collect()}
    assert got == {
        (0, "a::b::0"): None, (0, "a::b::3"): "{}", (0, "a::b::4::0::0"): "1.0", (0, "a::c"): None, (0, "d"): "[]", (0, "e"): "true",
        (6, "0"): "x", (6, "1::0"): None}
    for made in (shape_plans.customer_json, shape_plans.written_json):
        assert "rebalance" in _plan(made(spark, sf_dir)).lower()
