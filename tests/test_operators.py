"""Hand cases and properties of single operators."""

import json
import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestack.functions import conditions as c
from lodestack.operators import batching, context, extension, graphs, judgments, lint, matching
from lodestack.sources import records
from lodestack.streaming import signals as streams


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("build, want", [
    (lambda: c.char_at(F.lit("hello"), 1), "e"), (lambda: c.index_of(F.lit("hello"), "z"), -1), (lambda: c.index_of(F.lit("hello"), "l"), 2), (lambda: c.last_index_of(F.lit("hello"), "l"), 3),
    (lambda: c.last_index_of(F.lit("hello"), "z"), -1), (lambda: c.lower_ascii(F.lit("ÉA")), "Éa"), (lambda: c.replace(F.lit("a.a.a"), "a", "b", 2), "b.b.a"), (lambda: c.substring(F.lit("hello"), 1, 3), "el"),
    (lambda: c.trim(F.lit("\t a \n")), "a"), (lambda: c.size(F.lit(None).cast("string")), 0), (lambda: c.truthy(F.lit("False "), "string"), False), (lambda: c.truthy(F.lit(0), "int"), True),
    (lambda: c.truthy(F.lit(None).cast("string"), "string"), False), (lambda: c.to_text(F.lit(1e7), "double"), "10000000"), (lambda: c.split(F.lit("a.b."), "."), ["a", "b", ""]),
    (lambda: context.approved(F.lit(" YES ")), True), (lambda: judgments.normalize_confidence(F.lit('"low"')), "low"), (lambda: judgments.trim_code_fence(F.lit('```json\n{"a": 1}\n```')), '{"a": 1}'),
])
def test_functions(spark, build, want):
    assert value(spark, build()) == want


@pytest.mark.parametrize("template, want", [("{{", "{{"), ("}}", "}}"), ("{{missing}}", ""), ("{{inputs.a}}{{inputs.b}}", "12"), ("{{nested{{key}}}}", "}}"), ("{{  inputs.a  }}", "1"), ("x {{inputs.t}}", "x {{inputs.a}}")])
def test_templates(spark, template, want):
    df = spark.range(1).select(F.create_map(*map(F.lit, ["a", "1", "b", "2", "t", "{{inputs.a}}"])).alias("inputs"))
    assert df.select(context.interpolate(template).alias("v")).first()["v"] == want


@pytest.mark.parametrize("text, path, want, error", [('{"a": {"b": "c"}}', "a.b", "c", False), ('{"a": null}', "a", "", False), ('{"a": 1}', "b", "", True), ("[1]", "a", "", True), ("oops", "a", "", True), ("raw", "", "raw", False)])
def test_json_paths(spark, text, path, want, error):
    r = judgments.json_path_extract(spark.createDataFrame([(text,)], "t string"), "t", path).first()
    assert (r["extracted"], r["error"] != "") == (want, error)


def test_embedded_objects_are_recovered():
    rng = random.Random(1)
    for _ in range(200):
        obj = {"outcome_index": rng.randint(0, 9), "nested": {"x": "}{"[: rng.randint(0, 2)]}}
        text = f"{'prose {' * rng.randint(0, 2)} {json.dumps(obj)} {'tail'[: rng.randint(0, 4)]}"
        assert json.loads(judgments.last_object(text)) == obj


def test_dotted_types(spark):
    rows = [("foo", "foo", True), ("foo", "foo.bar", True), ("foo", "foobar", False), ("", "x", True), ("foo.bar", "foo", False)]
    df = spark.createDataFrame(rows, "w string, s string, want boolean")
    assert df.filter(matching.type_matches(F.col("w"), F.col("s")) != F.col("want")).count() == 0


def test_graph_walks():
    rng = random.Random(2)
    for _ in range(300):
        nodes = [f"n{i}" for i in range(rng.randint(1, 12))]
        edges = [(p, rng.choice(nodes), rng.choice([*nodes, "gone"])) for p in range(rng.randint(0, 20))]
        back, order = graphs.walk(nodes, edges)
        assert sorted(order) == sorted(nodes)
        place = {n: i for i, n in enumerate(order)}
        assert all(place[a] < place[b] for p, a, b in edges if p not in back and b in place)


def test_doubles_become_text_without_patterns(spark):
    """They read back, and no regular expression is in the plan."""
    rng = random.Random(8)
    xs = [rng.choice([-1, 1]) * rng.randrange(1, 10 ** rng.randint(1, 15)) * 10.0 ** rng.randint(-30, 30) for _ in range(500)] + [1e7, -1e7, 1e-3, 9999999.0, 12345678.5, 1.5e15, 0.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", c.to_text(F.col("x"), "double").alias("t"))
    for r in df.collect():
        assert "E" not in r["t"] and not r["t"].endswith(".0") and float(r["t"]) == r["x"], r
    assert "regexp" not in df._jdf.queryExecution().toString()


def test_batches_keep_errors(spark):
    df = spark.createDataFrame([(1, 2), (1, 3), (2, 0)], "k int, v int")
    got = {r["k"]: r for r in batching.apply_batches(df, ["k"], lambda p: 10 // int(p["v"].min()), "result long").collect()}
    assert (got[1]["result"], got[1]["status"], got[2]["status"]) == (5, "completed", "failed") and "zero" in got[2]["error"]


def test_items_over_the_limit_are_an_error(spark):
    df = spark.createDataFrame([("[1,2,3]",), ("[1]",), ("",), ("{}",)], "a string")
    rows = batching.explode_items(df, "a", 2).collect()
    assert sorted((r["a"], r["error"]) for r in rows) == [("[1,2,3]", "too many items"), ("[1]", ""), ("{}", "not an array")]


def test_compaction_skips_what_does_not_fit(spark):
    rows = [(1, 0, "system"), (1, 1, "user"), (1, 2, "assistant"), (1, 3, "user"), (1, 4, "assistant"), (1, 5, "user")]
    df = spark.createDataFrame([(a, b, r, "t") for a, b, r in rows], "conv_id long, turn long, role string, text string")
    assert sorted(r["turn"] for r in judgments.compact_transcript(df, 4).collect()) == [0, 3, 4, 5]


def test_unknown_operators_fail_before_anything_runs(spark):
    ops = extension.Operators()
    with pytest.raises(KeyError):
        ops.apply(spark.range(1), "nothing")


def test_operators_of_wrong_types_fail_at_registration(spark):
    ops, ran = extension.Operators(), []
    with pytest.raises(TypeError, match="x string .not bigint"):
        ops.register(spark, "a", lambda df: df.withColumn("x", F.col("id") + 1), "id bigint", "x string")
    with pytest.raises(TypeError, match="y bigint .not there"):
        ops.register(spark, "a", lambda df: df, "id bigint", "y bigint")
    ops.register(spark, "b", lambda df: ran.append(df) or df.withColumn("x", F.col("id") + 1), "id bigint", "x bigint")
    with pytest.raises(TypeError, match="takes id bigint .not string"):
        ops.apply(spark.range(1).select(F.col("id").cast("string").alias("id")), "b")
    assert len(ran) == 1 and [r["x"] for r in ops.apply(spark.range(2), "b").collect()] == [1, 2]


@pytest.mark.parametrize("x", [0.5, 1e-12, 1e30, 1e300, -2.5e-7, 123456789.125, 0.0, -0.0, 5e-324, 1.7976931348623157e308, 1e7, 0.001, 100.0, 1e22, -3.25])
def test_numbers_as_text_read_back(spark, x):
    from decimal import Decimal

    got = value(spark, c.to_text(F.lit(x), "double"))
    assert float(got) == x and "E" not in got.upper() and (Decimal(got) == Decimal(repr(x)) or abs(x) < 1e-320) and not (("." in got) and got.endswith("0"))


def test_numbers_without_a_decimal(spark):
    assert [value(spark, c.to_text(F.lit(x), "double")) for x in (float("nan"), float("inf"), float("-inf"))] == ["NaN", "+Inf", "-Inf"]
    assert value(spark, c.to_text(F.lit(None).cast("double"), "double")) == ""


@pytest.mark.parametrize("text, want", [("1h1h", 7200.0), ("0", 0.0), ("-0", 0.0), ("1\u00b5s", 1e-6), ("1\u03bcs", 1e-6), ("1.5h.5m2.s", 5432.0), ("-1m1ms1us1ns", -60.001001001), ("1", None), ("1h ", None), ("h", None), ("", None), ("1d", None), (".s", None)])
def test_durations(spark, text, want):
    got = value(spark, c.to_duration(F.lit(text)))
    assert got == want or got == pytest.approx(want, abs=1e-12)


def test_batches_stop_at_the_first_failure(spark, tmp_path):
    """fn is called once where the first of ten fails, and as often as there are batches up to it elsewhere; a null key is a key."""
    rows = [(k, i, (i, k)[0], bad) for k, bad in (("a", 0), ("b", 3), ("c", 99), (None, 1)) for i in range(10) for _ in range(2)]
    df = spark.createDataFrame(rows, "k string, i long, v long, bad long").repartition(4)

    def fn(pdf):
        with open(f"{tmp_path}/{pdf['k'].iloc[0]}-{pdf['i'].iloc[0]}", "a") as f:
            f.write("x")
        if pdf["v"].iloc[0] == pdf["bad"].iloc[0]:
            raise ValueError("stop")
        return len(pdf)

    got = batching.apply_batches(df, ["k", "i"], fn, "result long", "fail").collect()
    by = lambda k: [(r["status"], r["result"]) for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["i"])]
    assert by("a") == [("failed", None)] + [("skipped", None)] * 9 and by("b") == [("completed", 2)] * 3 + [("failed", None)] + [("skipped", None)] * 6
    assert by("c") == [("completed", 2)] * 10 and by(None)[1:3] == [("failed", None), ("skipped", None)]
    assert len(list(tmp_path.iterdir())) == 1 + 4 + 10 + 2 and all(f.read_text() == "x" for f in tmp_path.iterdir())
    for n in (0, 1, 3):
        every = batching.apply_batches(df, ["k", "i"], lambda p: 100 // int(p["v"].iloc[0]), "result long", concurrency=n).collect()
        assert sorted((str(r["k"]), r["i"], r["status"]) for r in every) == sorted((k, i, "completed" if i else "failed") for k in ("a", "b", "c", "None") for i in range(10))


def test_a_batch_may_span_frames(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        df = spark.range(40).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 16).alias("i"), "id")
        got = batching.apply_batches(df, ["k", "i"], lambda p: int(p["id"].sum()), "result long", "fail").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["k"], r["i"], r["result"]) for r in got) == sorted((k, i, sum(x for x in range(40) if x % 2 == k and x // 16 == i)) for k in (0, 1) for i in (0, 1, 2))


def test_batches_as_lists(spark):
    """The same rows as with frames, over batches that span frames, with null and NaN keys, failures and each kind of concurrency; no frame is made."""
    rows = [(k, x, i, v) for k in ("a", "b", None) for x in (1.0, float("nan"), None) for i, v in enumerate([4, 0, 5, None]) for _ in range(3)]
    df = spark.createDataFrame(rows, "k string, x double, i long, v long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)

    def fn(batch):
        assert type(batch) is dict and len(batch["v"]) == 3
        return sum(batch["v"]) * 10 // batch["v"][0], len(batch["v"]), 1

    try:
        for on_error, n in (("fail", 1), ("continue", 1), ("continue", 2), ("continue", 0)):
            got = batching.apply_batches(df, ["k", "x", "i"], fn, "result long", on_error, n, lists=True).collect()
            by = {(r["k"], str(r["x"]), r["i"]): r for r in got}
            assert len(got) == len(by) == 36
            for k, x, _, _ in rows:
                states = [(by[k, str(x), i]["status"], by[k, str(x), i]["result"], by[k, str(x), i]["input_tokens"]) for i in range(4)]
                last = [("skipped", None, 0)] * 2 if on_error == "fail" else [("completed", 30, 3), ("failed", None, 0)]
                assert states == [("completed", 30, 3), ("failed", None, 0), *last]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("depth", [10, 600, 5000])
def test_deep_objects_are_recovered(depth):
    deep = '{"a": [' * depth + "1" + "]}" * depth
    assert judgments.last_object(f"so {deep} ends") == deep and judgments.last_object(deep) == deep
    assert judgments.last_object(f'so {deep[:-1]},] then {{"b": 2}}') == '{"b": 2}'


def test_errors_in_json_are_placed():
    rng = random.Random(4)
    pieces = ["{", "}", "[", "]", ",", ":", '"a"', '"\\u00e9"', '"\\x"', "1", "-0.5e+3", "01", "true", "nul", " ", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 9)))
        try:
            judgments.strict().decode(text)
            good = True
        except ValueError:
            good = False
        assert (judgments.error_in(text) < 0) == good, text


def test_appends_know_null_ids_and_their_own_batch(spark, tmp_path):
    schema, path = "id long, type string", str(tmp_path / "log")
    ids = lambda: sorted((r["id"] is not None, r["id"] or 0) for r in spark.read.schema(schema).parquet(path).collect())
    first = spark.createDataFrame([(None, "x"), (1, "y"), (2_000_000, "z"), (None, "x")], schema)
    for n in (3, 0, 0):
        assert records.append_events(first, path).count() == n
    # A batch of a stream that is run again replaces itself.
    more = spark.createDataFrame([(5, "a"), (1, "y"), (None, "b")], schema)
    for _ in range(2):
        assert [r["id"] for r in records.append_events(more, path, batch=7).collect()] == [5]
    assert ids() == [(False, 0), (True, 1), (True, 5), (True, 2_000_000)]


def test_streams_do_not_replace_what_others_appended(spark, tmp_path):
    """An append by hand and two streams of several batches, whose files come in other orders: no row is lost or there twice."""
    schema, path = "id long, type string", str(tmp_path / "log")
    records.append_events(spark.createDataFrame([(1, "a"), (2, "a"), (30, "a")], schema), path)
    for name, files in (("x", [[3, 4], [5, 6], [1, 7, None]]), ("y", [[7, 5], [3, 8, None], [4, 6]]), ("x", [[9, 3]])):
        for ids in files:
            spark.createDataFrame([(x, "b") for x in ids], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        records.append_stream(stream, path, str(tmp_path / f"{name}-checkpoint"))
    got = sorted((r["id"] or 0, r["type"]) for r in spark.read.schema(schema).parquet(path).collect())
    assert got == [(0, "b"), (1, "a"), (2, "a"), *((i, "b") for i in range(3, 10)), (30, "a")]


def test_admission_counts_over_the_whole_table(spark):
    from lodestack.operators import outcomes

    cases = spark.createDataFrame([(i, i % 7, 100 - i) for i in range(50)], "run_id long, app_id long, started_at long").repartition(4)
    got = outcomes.admit(cases, 20, 5)
    assert sorted(r["run_id"] for r in got.filter("admitted").collect()) == list(range(35, 50)) and {r["reason"] for r in got.filter("NOT admitted").collect()} == {"queue full"}
    assert "Window" not in got._jdf.queryExecution().toString() and outcomes.admit(cases, 3, 9).filter("admitted").count() == 0


def test_flow_corpus(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps({"id": f"f{i}", "name": "x", "version": 1, "nodes": [{"id": "a", "type": "wait", "config": {"duration_seconds": 5}}, {"id": "b", "type": "return"}], "edges": [{"from": "a", "to": "b"}]}))
    flows, nodes, edges = records.read_flows(spark, str(tmp_path))
    assert flows.count() == 3 and nodes.count() == 6 and edges.filter("src = 'a' AND dst = 'b' AND max_traversals = 0").count() == 3


def test_corrupt_record_fails(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"run_id": 1\n')
    with pytest.raises(Exception):
        records.read_cases(spark, str(tmp_path)).collect()


def test_nested_definitions(spark):
    good = {"nodes": [{"id": "a", "type": "wait"}, {"id": "r", "type": "return", "config": {"value": {"status": "success"}}}], "edges": [{"from": "a", "to": "r"}]}
    bad = {"nodes": [{"id": "a", "type": "wait"}], "edges": []}
    off = {"nodes": [{"id": "r", "type": "return", "config": {"value": {"status": 1}}}], "edges": []}
    configs = {"m1": ("map", {"items_key": "x", "inline": good}), "m2": ("map", {"items_key": "x", "inline": bad}), "g1": ("gadget", {"inline": good}), "g2": ("gadget", {"blueprint_json": json.dumps(off)}), "m3": ("map", {"items_key": "x", "inline": off}),
               "t1": ("agent_loop", {"prompt": "p", "tools": [{"name": "t", "inline": good}, {"name": "u", "inline": bad}]})}
    nodes = spark.createDataFrame([(1, n, t, json.dumps(c)) for n, (t, c) in configs.items()], "flow_id long, node_id string, type string, config string")
    got = {(r["target"], r["code"]) for r in lint.inline_issues(nodes).collect()}
    assert got == {("m2", "MAP_INLINE_INVALID"), ("g2", "GADGET_BLUEPRINT_INVALID"), ("t1", "AGENT_LOOP_BLUEPRINT_TOOL_INLINE_INVALID")}


def test_unusable_definitions_are_issues(spark):
    flows = spark.createDataFrame([("a", ""), ("b", "{"), ("c", '{"nodes": []}'), ("d", "x" * 20000)], "flow_id string, raw string")
    nodes = spark.createDataFrame([], "flow_id string, pos long, node_id string, type string, config string")
    edges = spark.createDataFrame([], "flow_id string, pos long, src string, dst string, condition string, max_traversals long")
    got = {r["flow_id"]: (r["valid"], r["first_code"]) for r in lint.lint(flows, nodes, edges).collect()}
    assert got == {"a": (False, "BLUEPRINT_JSON_REQUIRED"), "b": (False, "BLUEPRINT_JSON_INVALID"), "c": (False, "EMPTY_BLUEPRINT"), "d": (False, "BLUEPRINT_JSON_INVALID")}


def test_one_use_signals_serve_waits_of_any_key(spark):
    """Against a serial run over all waits, in several blocks and in one."""
    rng = random.Random(4)
    types = ["", "a", "b", "a.x"]
    waits = [(i, "timer" if i % 9 == 0 else "signal", rng.choice(["", "k1", "k2", "k3"]), rng.choice(types), rng.random() < 0.5, rng.randint(0, 30)) for i in range(60)]
    signals = [(i, f"i{rng.randint(0, 40)}", rng.choice(["k1", "k1", "k2", "k4"]), rng.choice(["a", "a.x", "ab", "b", "b.y"]), rng.choice(["", "yes"])) for i in range(50)]
    w = spark.createDataFrame(waits, "wait_id long, kind string, correlation_key string, signal_type string, needs_outcome boolean, parked_unix long")
    s = spark.createDataFrame(signals, "event_id long, idempotency_key string, correlation_key string, signal_type string, payload_outcome string")
    used, want = set(), []
    for i, kind, key, kind_of, needs, _ in sorted(waits, key=lambda r: (r[5], r[0])):
        fits = lambda r: key in ("", r[2]) and (kind_of in ("", r[3]) or r[3].startswith(kind_of + ".")) and (r[4] or not needs) and r[0] not in used  # noqa: B023, E731
        best = min(((r[1], r[0]) for r in signals if fits(r)), default=None) if kind == "signal" else None
        if best:
            used.add(best[1])
            want.append((i, *best))
    any_key = {r[0] for r in waits if r[2] == ""}
    assert any_key & {r[0] for r in want}
    for size in (7, 25, 1000):
        assert sorted(tuple(r) for r in matching.assign_in_blocks(w, s, size).collect()) == sorted(want), size
    # Rounds give the same, in chunks of any size, and so does what picks between the two.
    for chunk in (3, 100_000):
        assert sorted(tuple(r) for r in matching.assign_in_rounds(w, s, chunk).collect()) == sorted(want), chunk
    assert sorted(tuple(r) for r in matching.assign_once(w, s).collect()) == sorted(want)
    assert matching.assign_once(w.filter("false"), s).count() == 0


def test_rounds_do_not_grow_with_waits(spark, monkeypatch):
    """Ten times as many waits of random keys take about as many rounds, and some get what a serial run gives them."""
    done, write = [], matching.written
    monkeypatch.setattr(matching, "written", lambda df, label: done.append(label) or write(df, label))
    rounds = []
    for n in (300, 3000):
        rng = random.Random(n)
        waits = [(i, "signal", f"k{rng.randrange(n // 2)}", rng.choice(["", "a", "b"]), rng.random() < 0.5, rng.randrange(10**6)) for i in range(n)]
        signals = [(i, f"i{rng.randrange(10**6)}", f"k{rng.randrange(n // 2)}", rng.choice(["a", "a.x", "b"]), rng.choice(["", "y"])) for i in range(2 * n)]
        w = spark.createDataFrame(waits, "wait_id long, kind string, correlation_key string, signal_type string, needs_outcome boolean, parked_unix long")
        s = spark.createDataFrame(signals, "event_id long, idempotency_key string, correlation_key string, signal_type string, payload_outcome string")
        used, want = set(), []
        own = {}
        for r in sorted(signals, key=lambda r: (r[1], r[0])):
            own.setdefault(r[2], []).append(r)
        for i, _, key, kind_of, needs, _ in sorted(waits, key=lambda r: (r[5], r[0])):
            best = next((r for r in own.get(key, []) if matching.dotted_match(kind_of, r[3]) and (r[4] or not needs) and r[0] not in used), None)
            if best:
                used.add(best[0])
                want.append((i, best[1], best[0]))
        done.clear()
        assert sorted(tuple(r) for r in matching.assign_once(w, s).collect()) == sorted(want)
        rounds.append(done.count("rounds"))
    assert rounds[1] <= rounds[0] + 4


@pytest.mark.parametrize("loose", [False, True])
def test_waits_that_all_compete_take_one_round(spark, monkeypatch, loose):
    """All waits of one key, or of any, hang on each other in a chain; a block of signals settles them all the same."""
    done, write = [], matching.written
    monkeypatch.setattr(matching, "written", lambda df, label: done.append(label) or write(df, label))
    waits = [(i, "signal", "" if loose and i % 2 else "k", ["", "a", "b"][i % 3], i % 5 == 0, i) for i in range(150)]
    signals = [(i, f"i{i * 37 % 300:03}", "k", ["a", "b", "a.x"][i % 3], "y" if i % 2 else "") for i in range(300)]
    w = spark.createDataFrame(waits, "wait_id long, kind string, correlation_key string, signal_type string, needs_outcome boolean, parked_unix long")
    s = spark.createDataFrame(signals, "event_id long, idempotency_key string, correlation_key string, signal_type string, payload_outcome string")
    used, want = set(), []
    for i, _, _, kind_of, needs, _ in waits:
        best = min(((r[1], r[0]) for r in signals if matching.dotted_match(kind_of, r[3]) and (r[4] or not needs) and r[0] not in used), default=None)
        if best:
            used.add(best[1])
            want.append((i, *best))
    assert sorted(tuple(r) for r in matching.assign_once(w, s).collect()) == sorted(want) and done.count("rounds") == 1


def test_every_issue_code_and_field_is_in_a_case():
    from lodestack.plans import lint_queries as q

    codes = {code for own in lint.rules().values() for code, _ in own} | {f"{lint.PREFIX.get(t, t.upper())}_CONFIG_INVALID" for t in extension.FIELDS}
    assert {x for _, _, c in q.CASES for x in c.split()} == codes
    right = {t: [json.loads(c) for x, c, codes in q.CASES if x == t and not codes] for t in extension.FIELDS}
    one_of = {"gadget": {"blueprint_json", "inline"}}
    assert all(set().union(*right[t]) | one_of.get(t, set()) == set(fields) for t, fields in extension.FIELDS.items())


def test_streamed_matches_have_no_limit_in_time(spark, tmp_path):
    """Signals years from their waits, before and after, late ones, and waits of any key."""
    waits = [(1, "k", "a", "2024-01-01"), (2, "k", "", "2031-06-01"), (3, "", "a", "2024-01-02"), (4, "", "", "2020-01-01"), (5, "none", "a", "2024-01-01")]
    signals = [(1, "k", "a.x", "2032-01-01"), (2, "k", "ab", "2016-01-01"), (3, "z", "a", "2024-01-01")]
    sides = []
    for name, rows, schema in (("w", waits, "wait_id long, wait_key string, wait_type string, parked_at string"), ("s", signals, "event_id long, signal_key string, signal_type string, observed_at string")):
        df = spark.createDataFrame(rows, schema)
        df = df.withColumn(df.columns[3], F.col(df.columns[3]).cast("timestamp"))
        df.repartition(3).write.parquet(str(tmp_path / name))
        sides.append(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    got = [tuple(r) for r in streams.drain(streams.match_stream(*sides)).collect()]
    assert sorted(got) == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 3), (4, 1), (4, 2), (4, 3)]


def test_streamed_matches_are_kept_in_blocks(spark, tmp_path, monkeypatch):
    """All pairs, each once, in few rows, also where blocks are cut; a signal of no type goes to waits of any type, as in SQL."""
    monkeypatch.setattr(streams, "BLOCK", 7)
    monkeypatch.setattr(streams, "HELD", 50)
    kinds = ["", "a", "a.x", "ab", None]
    waits = [(i, ["", "k", "l", None][i % 4], kinds[i // 4 % 5]) for i in range(200)]
    signals = [(i, ["", "k", "l", None][i % 4], ["a", "a.x.y", "ab", "", None][i // 4 % 5]) for i in range(300)]
    sides = []
    for name, rows, schema in (("w", waits, "wait_id long, wait_key string, wait_type string"), ("s", signals, "event_id long, signal_key string, signal_type string")):
        df = spark.createDataFrame(rows, schema)
        df.repartition(3).write.parquet(str(tmp_path / name))
        sides.append(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    takes = lambda w, g: w is not None and (w == "" or g is not None and (w == g or g.startswith(f"{w}.")))
    due = sorted((w, g) for w, wk, wt in waits for g, gk, gt in signals if wk is not None and (wk == "" or wk == gk) and takes(wt, gt))
    blocks = streams.drain(streams.match_blocks(*sides))
    assert blocks.count() < len(due) / 10
    assert blocks.agg(F.max(F.size("wait_ids")), F.max(F.size("event_ids"))).first()[:] <= (7, 7)
    assert sorted(tuple(r) for r in streams.spread_pairs(blocks, 100).collect()) == due
    assert sorted(tuple(r) for r in streams.drain(streams.match_stream(*sides)).collect()) == due


def test_pairs_are_handed_on_wait_by_wait(spark):
    """The first pair of a block is there before the block's other pairs are made."""
    block = spark.createDataFrame([(list(range(50)), list(range(40)))], "wait_ids array<long>, event_ids array<long>")
    one = streams.pairs(block).limit(1)
    assert len(one.collect()) == 1
    made, nodes = [], [one._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Generate":
            made.append(node.metrics().apply("numOutputRows").value())
    assert max(made) <= 50
    assert sorted(tuple(r) for r in streams.pairs(block).collect()) == [(w, g) for w in range(50) for g in range(40)]


def test_one_class_is_joined_by_several_tasks(spark, tmp_path, monkeypatch):
    """Waits of any key and type are of one class, and take all signals."""
    monkeypatch.setattr(streams, "BLOCK", 5)
    sides = []
    for name, n, schema in (("w", 7, "wait_id long, wait_key string, wait_type string"), ("s", 400, "event_id long, signal_key string, signal_type string")):
        df = spark.createDataFrame([(i, "", "") for i in range(n)], schema)
        df.write.parquet(str(tmp_path / name))
        sides.append(spark.readStream.schema(df.schema).parquet(str(tmp_path / name)))
    blocks = streams.drain(streams.match_blocks(*sides))
    assert blocks.select(F.input_file_name()).distinct().count() > 3
    assert sorted(tuple(r) for r in streams.spread_pairs(blocks).collect()) == [(w, g) for w in range(7) for g in range(400)]


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_batches_of_runs_are_dealt_once_to_tasks_of_few_rows(spark, data, monkeypatch):
    """However long the table is, a task gets some LINES rows of it, and windows of runs need no second shuffle."""
    from lodestack.plans import text_queries, views

    monkeypatch.setattr(views, "LINES", 200)
    rows = spark.read.parquet(f"{data}/lineitem.parquet").count()
    for name in ("bat_4_skip_after_failure", "bat_5_rollup"):
        df = text_queries.Q[name](spark, data)
        assert shuffles(df) == 1
        assert df.rdd.getNumPartitions() == -(-rows // 200) > 8


def test_skipping_looks_at_the_first_failure(spark):
    """A null index comes first; runs without a failure stay; rows are not sorted again."""
    rows = [("a", 0, "completed"), ("a", 1, "failed"), ("a", 2, "failed"), ("a", 3, "completed"), ("b", 0, "completed"), ("b", 1, None), ("c", None, "failed"), ("c", 0, "completed"), (None, 0, "failed"), (None, 1, "completed")]
    df = spark.createDataFrame(rows, "k string, i long, status string")
    due = [("a", 0, "completed"), ("a", 1, "failed"), ("a", 2, "skipped"), ("a", 3, "skipped"), ("b", 0, "completed"), ("b", 1, None), ("c", None, "failed"), ("c", 0, "skipped"), (None, 0, "failed"), (None, 1, "skipped")]
    assert sorted((tuple(r) for r in batching.skip_after_failure(df, "k", "i").collect()), key=str) == sorted(due, key=str)
    placed = df.repartition(3, "k").withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("i")))
    assert batching.skip_after_failure(placed, "k", "i")._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1


def test_issues_are_judged_where_their_lines_were_dealt(spark, data, monkeypatch):
    from lodestack.plans import outcome_queries, views

    monkeypatch.setattr(views, "LINES", 200)
    df = outcome_queries.Q["agg_7_is_valid"](spark, data)
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
    assert df.rdd.getNumPartitions() > 8


def test_a_written_corpus_is_compressed(spark, data, tmp_path, monkeypatch):
    from lodestack.plans import lint_queries

    path = str(tmp_path / "flows")
    monkeypatch.setattr(lint_queries, "folder", lambda df, label: path)
    got = lint_queries.Q["src_3_read_flows"](spark, data).count()
    assert got == lint_queries.view(spark, data, "v_flow_edges").count()
    files = [f"{path}/{f}" for f in os.listdir(path) if f.startswith("part-")]
    text = spark.read.text(path).agg(F.sum(F.octet_length("value"))).first()[0]
    assert sum(map(os.path.getsize, files)) < text / 4


@pytest.mark.parametrize("turned", [False, True])
def test_long_chains_are_walked_to_their_end(spark, turned):
    n = 500
    order = range(n - 1) if not turned else range(n - 2, -1, -1)
    nodes = spark.createDataFrame([(1, i, f"n{i}", "return" if i == n - 1 else "wait") for i in range(n)], "flow_id long, pos long, node_id string, type string")
    edges = spark.createDataFrame([(1, p, f"n{i}", f"n{i + 1}", 0) for p, i in enumerate(order)], "flow_id long, pos long, src string, dst string, max_traversals long")
    assert {r["code"] for r in graphs.structure_issues(nodes, edges, ["wait", "return"]).collect()} == {"TOO_MANY_NODES"}
    assert graphs.reaches(nodes, edges).count() == graphs.reachable(nodes, edges).count() == n


def test_issues_come_in_the_order_of_the_rules():
    nodes = [(0, "a", "wait"), (1, "a", "odd"), (2, "b", "return")]
    edges = [(0, "a", "b", 0), (1, "a", "b", 0), (2, "b", "b", 0), (3, "x", "y", 0)]
    got = [(i[2], i[3]) for i in graphs.issues_of(nodes, edges, {"wait", "return"})]
    assert got == [
        ("DUPLICATE_NODE_ID", "a"), ("UNKNOWN_NODE_TYPE", "a"), ("DUPLICATE_EDGE", "a->b"), ("SELF_LOOP", "b->b"), ("DANGLING_EDGE_SOURCE", "x->y"), ("DANGLING_EDGE_TARGET", "x->y"),
        ("BACK_EDGE_MISSING_MAX_TRAVERSALS", "b->b"), ("RETURN_HAS_OUTGOING", "b"),
    ]


def test_one_of_several_rows_of_a_run_is_taken(spark):
    stored = spark.createDataFrame([(1, 4, "running"), (2, 1, "failed"), (3, 0, "running")], "run_id long, revision long, status string")
    rows = [(1, 4, "completed", 2), (1, 4, "failed", 1), (1, 4, "failed", 1), (1, 3, "running", 0), (2, 1, "running", 0), (9, 0, "queued", 5), (9, 0, "queued", 4), (9, 1, "running", 0)]
    table, rejects = records.upsert_revisions(stored, spark.createDataFrame(rows, "run_id long, revision long, status string, seq long"), "seq")
    assert sorted(tuple(r) for r in table.collect()) == [(1, 5, "failed"), (2, 1, "failed"), (3, 0, "running"), (9, 1, "queued")]
    got = sorted((r["run_id"], r["revision"], r["status"]) for r in rejects.collect())
    assert got == [(1, 3, "running"), (1, 4, "completed"), (1, 4, "failed"), (2, 1, "running"), (9, 0, "queued"), (9, 1, "running")]


@pytest.mark.parametrize("text, want", [
    ("{" * 500_000 + "}" * 500_000, "{}"), ("}" * 1_000_000, None), ("{a}" * 300_000, None), ("[" * 200_000, None), ('{"a":' * 200_000 + "1" + "}" * 200_000, None), ('he said "hi {"a": "}"} there', '{"a": "}"}'), ("{a {\"b\": 1} }", '{"b": 1}'), ('{"a": NaN}', None),
], ids=["nested", "closers", "broken", "brackets", "deep", "quotes", "inner", "nan"])
def test_hostile_text(text, want):
    import time

    began = time.time()
    assert judgments.last_object(text) == (text if want is None else want)
    assert time.time() - began < 20


def test_definitions_nested_in_gadgets(spark):
    """A broken map body three levels down breaks every gadget above it; a broken body within a map's nodes does not."""
    ends = lambda *nodes: {"nodes": [*nodes, {"id": "r", "type": "return", "config": {"value": {"status": "success"}}}], "edges": [{"from": n["id"], "to": "r"} for n in nodes]}
    bad = {"nodes": [{"id": "a", "type": "wait"}], "edges": []}
    broken = {"id": "m", "type": "map", "config": {"items_key": "x", "inline": bad}}
    gadget = lambda body: {"id": "g", "type": "gadget", "config": {"inline": body}}
    top = {"deep": ("gadget", gadget(ends(gadget(ends(broken))))["config"]), "fine": ("gadget", gadget(ends(gadget(ends())))["config"]), "body": ("map", {"items_key": "x", "inline": ends(broken)})}
    nodes = spark.createDataFrame([(1, n, t, json.dumps(c)) for n, (t, c) in top.items()], "flow_id long, node_id string, type string, config string")
    assert [(r["target"], r["code"]) for r in lint.inline_issues(nodes).collect()] == [("deep", "GADGET_INLINE_INVALID")]


def test_pairs_of_hot_keys(spark):
    """Salted or not, the pairs are those of a plain comparison, and their totals those of match_totals."""
    rng = random.Random(5)
    waits = [(i, "signal", rng.choice(["", "k1", "k2"]), rng.choice(["", "a", "a.x"])) for i in range(30)]
    signals = [(i, rng.choice(["k1", "k1", "k2"]), rng.choice(["a", "a.x", "ab"])) for i in range(60)]
    w = spark.createDataFrame(waits, "wait_id long, kind string, correlation_key string, signal_type string")
    s = spark.createDataFrame(signals, "event_id long, correlation_key string, signal_type string")
    want = sorted((i, j) for i, _, k, t in waits for j, key, typ in signals if k in ("", key) and matching.dotted_match(t, typ))
    for per_salt in (7, 1000):
        assert sorted(tuple(r) for r in matching.match_signals(w, s, per_salt).collect()) == want
    totals = {r["wait_id"]: (r["n"], r["first_event"], r["events"]) for r in matching.match_totals(w, s).collect()}
    for i in {a for a, _ in want}:
        own = [b for a, b in want if a == i]
        assert totals[i] == (len(own), min(own), sum(own))


@pytest.mark.parametrize("host, want", [("[::1]", True), ("[0:0:0:0:0:0:0:1]", True), ("[fd12:3456::1]", True), ("[fe80::1]", True), ("[::ffff:10.0.0.1]", True), ("[::ffff:7f00:1]", True), ("[2001:db8::7f00:1]", False), ("127.9.9.9", True), ("11.0.0.1", False), ("LOCALHOST", True)])
def test_screened_hosts(spark, host, want):
    from lodestack.operators import outcomes

    assert outcomes.blocked_urls(spark.createDataFrame([(f"http://{host}/x",)], "url string")).first()["blocked"] == want


def test_identifiers_of_conditions(spark):
    text = "results.a.list.size() > 1 && status in list && 'x.y' != fetch.value.split(' ')[0] && .odd 3x trim matches exists_one"
    got = spark.createDataFrame([(text,)], "c string").select(context.referenced_fields(F.col("c")).alias("v")).first()["v"]
    assert got == ["results.a.list", "status", "fetch.value", "trim", "exists_one"]


def test_equal_configs_are_judged_once(spark):
    """Nodes of equal type and config share one verdict, which the rules give above the distinct pairs; null types and configs stay what they were."""
    configs = [("map", '{"batch_size": -1}'), ("map", None), ("wait", '{"mode": "nap"}'), ("wait", '{"mode": "defer"}'), ("return", "[]"), (None, "{}"), ("other", "{}")]
    nodes = [(i, f"n{j}", *c, j) for i in range(20) for j, c in enumerate(configs)]
    out = lint.config_issues(spark.createDataFrame(nodes, "flow_id long, node_id string, type string, config string, pos long"))
    got = sorted((r["flow_id"], r["target"], r["code"], r["place"], r["k"]) for r in out.collect())
    own = [("n0", "MAP_ITEMS_KEY_REQUIRED", 0, 0), ("n0", "MAP_INLINE_REQUIRED", 0, 1), ("n0", "MAP_BATCH_SIZE_INVALID", 0, 2), ("n1", "MAP_ITEMS_KEY_REQUIRED", 1, 0), ("n1", "MAP_INLINE_REQUIRED", 1, 1), ("n2", "WAIT_MODE_INVALID", 2, 0), ("n4", "RETURN_CONFIG_INVALID", 4, 0)]
    assert got == sorted((i, *x) for i in range(20) for x in own)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    rules, below = plan.split("Aggregate [type")[1].split("\n", 1)
    assert "WAIT_MODE_INVALID" in rules and "WAIT_MODE_INVALID" not in below
