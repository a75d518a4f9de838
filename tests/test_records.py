from __future__ import annotations

import json
from datetime import datetime as D

from pyspark.sql import functions as F

from trailmill.operators import nested, references, schema_drift


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_orphans(spark, folder):
    d = folder(
        extra=True,
        intents=[
            {"intent_id": "A", "loaded_at": D(2025, 1, 1), "deleted_at": D(2025, 3, 1)},
            {"intent_id": "A", "loaded_at": D(2025, 5, 1)},  # created again
            {"intent_id": "late", "loaded_at": D(2025, 9, 1)},
            {"intent_id": "never", "loaded_at": D(2025, 2, 2), "deleted_at": D(2025, 2, 1)},
            {"intent_id": None, "loaded_at": D(2025, 1, 1)},
            {"intent_id": "unknown-time", "loaded_at": None},
        ],
        stages=[
            {"stage_id": "ok", "parent_intent_id": " a ", "loaded_at": D(2025, 1, 1)},  # at the very load time
            {"stage_id": "gone", "parent_intent_id": "A", "loaded_at": D(2025, 3, 1)},  # at the very deletion
            {"stage_id": "gone", "parent_intent_id": "A", "loaded_at": D(2025, 1, 9), "name": "first arrival"},
            {"stage_id": "gone2", "parent_intent_id": "a", "loaded_at": D(2025, 4, 1)},
            {"stage_id": "back", "parent_intent_id": "A", "loaded_at": D(2025, 5, 1)},
            {"stage_id": "l", "parent_intent_id": "LATE", "loaded_at": D(2025, 8, 31)},
            {"stage_id": "m", "parent_intent_id": "nobody", "loaded_at": D(2025, 8, 31)},
            {"stage_id": "n", "parent_intent_id": "never", "loaded_at": D(2025, 8, 31)},
            {"stage_id": "u", "parent_intent_id": "unknown-time", "loaded_at": D(2025, 8, 31)},
            {"stage_id": "blank", "parent_intent_id": "  ", "loaded_at": D(2025, 8, 31)},
            {"stage_id": "null", "parent_intent_id": None, "loaded_at": D(2025, 8, 31)},
            {"stage_id": None, "parent_intent_id": "nobody", "loaded_at": D(2025, 8, 31)},
        ],
    )
    assert rows(references.found(spark, d)) == [
        ("stages", "gone2", "deleted", "2025-04"), ("stages", "l", "late", "2025-08"), ("stages", "m", "missing", "2025-08"),
        ("stages", "n", "deleted", "2025-08"), ("stages", "u", "late", "2025-08"),
    ]


def test_empty_tables(spark, folder):
    d = folder()
    for q in (references.found, references.report, references.current_report, nested.found, nested.task_steps, nested.trace_table, schema_drift.found, schema_drift.spans, schema_drift.steps):
        assert q(spark, d).count() == 0


def test_state_of_references_by_batches_equals_one_batch(spark):
    deltas = [("k1", 1, 0), ("K1 ", 1, 0), ("k2", 1, 0), ("k1", 0, 1), ("k2", 0, 1), ("k2", 0, -1), ("k3", 1, 0), ("k3", -1, 0), (None, 1, 0), (" ", 1, 0)]
    df = lambda x: spark.createDataFrame(x, "key string, refs int, exists int")
    state = None
    for i in range(0, len(deltas), 3):
        state = references.apply_deltas(state, df(deltas[i : i + 3]))
    assert rows(references.current_orphans(state)) == [("k2", 1)] == rows(references.current_orphans(references.apply_deltas(None, df(deltas))))


def _cand(**k):
    return {"backend_node_id": None, "node_id": None, "tag": None, "role": None, "text": None, "attributes": None, "parent_context": None, "sibling_text": None} | k


def _step(i, *pos):
    return {"step_index": i, "action_uid": None, "operation": "click", "value": None, "action_repr": None, "url": None, "pos_candidates": list(pos) or None, "neg_candidates": None}


def test_links(spark, folder):
    step = lambda i, t: {"step_index": i, "target": t}
    deep = json.dumps([step("2", [{"uid": 7}]), {"index": 5, "target": {"element_id": "", "attributes": {"id": "z"}}}, {"target": {"ref": "r"}}, 3, {"target": None}, {"target": {"role": "x"}}])
    d = folder(
        extra=True,
        tasks=[
            {"task_id": "t", "steps": [_step(None, _cand(node_id="a"), _cand(backend_node_id="", attributes={"node_id": "b"})), _step(9, _cand())]},
            {"task_id": "t", "steps": [_step(None, _cand(node_id="a"))]},
            {"task_id": "none", "steps": None}, {"task_id": "zero", "steps": []}, {"task_id": None, "steps": [_step(0, _cand(node_id="q"))]},
        ],
        episode_traces=[
            {"task_id": "list", "trajectory": deep},
            {"task_id": "text", "trajectory": json.dumps(json.dumps([step(1, {"id": "e"})]))},
            {"task_id": "held", "trajectory": json.dumps({"steps": [step(1, {"id": "e"})]})},
            {"task_id": "byplace", "trajectory": json.dumps({"0": {"target": {"id": "p"}}, "10": {"target": {"id": "q"}}, "2": {"target": {"id": "r"}}})},
            {"task_id": "cut", "trajectory": deep[:-9]}, {"task_id": "null", "trajectory": None}, {"task_id": "blank", "trajectory": ""}, {"task_id": "num", "trajectory": "3"},
        ],
    )
    e = "episode_traces"
    assert rows(nested.found(spark, d)) == sorted([
        ("tasks", "t", 0, "a"), ("tasks", "t", 0, "b"), (e, "list", 2, "7"), (e, "list", 5, "z"), (e, "list", 2, "r"), (e, "text", 1, "e"), (e, "held", 1, "e"),
        (e, "byplace", 0, "p"), (e, "byplace", 10, "q"), (e, "byplace", 2, "r"),
    ])


def test_flatten_keeps_links_and_clashing_names(spark):
    df = spark.sql("select 'k' as id, 1 as _id, named_struct('b', 2) as a, 3 as a_b, array(array(1,2), array(3)) as m, array(named_struct('x', array(named_struct('y', 5)))) as s")
    t = nested.flatten(df, F.col("id"), "r", carry=("id", "_ordinal"))
    assert set(t) == {"r", "r.m", "r.s", "r.s.x"}
    root, s, x = t["r"].first(), t["r.s"].first(), t["r.s.x"].first()
    assert root["a_b"] == 2 and root["a_b_"] == 3 and root["_id_"] == 1
    assert s["_parent"] == root["_id"] and x["_parent"] == s["_id"] and x["y"] == 5 and x["up_id"] == "k"
    assert [r["items"] for r in t["r.m"].orderBy("_ordinal").collect()] == [[1, 2], [3]]


def _raw(feed, no, *payloads):
    return [{"feed": feed, "file_name": f"{feed}/{no}", "file_no": no, "line_no": i, "payload": p if p is None or isinstance(p, str) else json.dumps(p)} for i, p in enumerate(payloads)]


def test_drift(spark, folder):
    a = {"task_id": "1", "confirmed_task": "x", "n": 1, "actions": [{"op": "click", "pos_candidates": {"tag": "a", "attributes": {"k": 1}}}]}
    b = {"task_id": 1, "confirmedTask": "x", "extra": None, "new": True, "actions": [{"operation": "click", "pos_candidates": [{"tag": "a"}]}]}
    c = {"task_id": 2, "confirmedTask": {"text": "x"}, "new": [1]}
    d = folder(
        extra=True,
        raw_records=[*_raw("f", 1, a, a, a | {"task_id": 5}, '{"cut": ', " ", None, "[1]"), *_raw("f", 4, b), *_raw("f", 5, c), *_raw("g", 2, c), *_raw(None, 1, a), *_raw("h", 1, "{"), *_raw("h", 2, c)],
    )
    want = {
        ("f/4", "retyped", "task_id", "task_id"), ("f/4", "renamed", "confirmed_task", "confirmedTask"), ("f/4", "removed", "n", ""), ("f/4", "added", "", "new"),
        ("f/4", "renamed", "actions[].op", "actions[].operation"), ("f/4", "retyped", "actions[].pos_candidates", "actions[].pos_candidates"),
        ("f/5", "retyped", "confirmedTask", "confirmedTask"), ("f/5", "retyped", "new", "new"), ("f/5", "removed", "actions", ""),
        ("h/2", "added", "", "task_id"), ("h/2", "added", "", "confirmedTask"), ("h/2", "added", "", "new"),
    }
    got = rows(schema_drift.found(spark, d))
    assert len(got) == len(set(got)) and set(got) == want
    steps = schema_drift.steps(spark, d).where("feed = 'f'").orderBy("file_no", "line_no").collect()
    assert [(r["task_id"], r["instruction"], r["operation"], r["n_pos"]) for r in steps] == [("1", "x", "click", 1)] * 2 + [("5", "x", "click", 1), ("1", "x", "click", 1), ("2", "x", None, None)]


def test_one_table_keeps_every_value(spark, folder):
    one = {
        "id": "1", "task_id": "2", "confirmed_task": {"text": "x", "lang": "en"}, "action_reprs": "[a]  A | B -> CLICK | [b]  C -> CLICK", "locale": ["en"], "viewport": {"w": 1},
        "num_steps": "2", "new": {"k": [1]}, "success": "perhaps",
        "actions": [
            {"op": {"op": "click", "original_op": "CLICK"}, "confidence": "0.5", "screenshot": "s.png", "pos_candidates": {"tag": "a", "visible_text": "T", "bbox": [1, 2]}},
            {"op": "type", "index": "two", "novel": True, "neg_candidates": [{"ref": 3, "attributes": {"k": "v"}}, {"ref": 4}]},
        ],
    }
    two = {"id": "3", "action_reprs": ["p", "q", "r"], "actions": {"10": {"repr": ["button", "Save", "click"]}, "9": "wait"}}
    d = folder(extra=True, raw_records=_raw("f", 1, one, two))
    a, b, c, e = schema_drift.steps(spark, d).orderBy("line_no", "step_pos").collect()
    assert [r["action_repr"] for r in (a, b, c, e)] == ["[a]  A | B -> CLICK", "[b]  C -> CLICK", "p", "button Save click"]
    assert (a["task_id"], a["instruction"], a["locale"], a["viewport"], a["num_steps"], a["success"]) == ("2", "x", "en", '{"w": 1}', 2, None)
    assert a["record_fields"] == b["record_fields"] == {"id": "1", "confirmed_task.lang": "en", "new": '{"k": [1]}', "success": "perhaps"}
    assert (a["operation"], a["confidence"], a["screenshot"], a["step_fields"]) == ("click", 0.5, "s.png", {"operation.original_op": "CLICK"})
    assert a["pos_candidates"] == [{"tag": "a", "text": "T", "bbox": "[1, 2]"}] and a["neg_candidates"] == []
    assert b["neg_candidates"] == [{"backend_node_id": "3", "attributes": '{"k": "v"}'}, {"backend_node_id": "4"}] and (b["n_pos"], b["n_neg"]) == (0, 2)
    assert b["step_index"] is None and b["step_fields"] == {"step_index": "two", "novel": "true"} and b["confidence"] is None
    assert c["step_fields"] == {"step": "wait"} and e["step_fields"] == {"action_repr": '["button", "Save", "click"]'}
    assert e["record_fields"] == {"action_reprs": '["p", "q", "r"]'}


def test_all_nested_parts_are_linked_tables(spark, folder):
    from trailmill.plans import records

    seen = {"text": "page", "candidates": [{"element_id": "c1", "role": "link"}, {"element_id": 2}]}
    deep = [
        {"step_index": 4, "observation": "as text", "target": {"id": "a", "attributes": {"class": "k"}}},
        {"observation": seen, "target": [{"id": 7}, "b"], "operation": "click"},
    ]
    d = folder(
        extra=True,
        tasks=[{"task_id": "t", "steps": [_step(3, _cand(node_id="p")) | {"neg_candidates": [_cand(node_id="n"), _cand(node_id="m")]}]}],
        episode_traces=[{"task_id": "x", "trajectory": json.dumps(deep)}, {"task_id": "y", "trajectory": json.dumps({"steps": deep[:1]})}, {"task_id": "cut", "trajectory": "[{"}, *[{"task_id": "same", "trajectory": "[{}]"}] * 2],
    )
    q = {k: f(spark, d).collect() for k, f in records.queries().items() if k.startswith("p5_t")}
    for child, parent in (("tasks_steps", "tasks"), ("tasks_pos", "tasks_steps"), ("tasks_neg", "tasks_steps"), ("trace_steps", "traces"), ("trace_targets", "trace_steps"), ("trace_candidates", "trace_steps")):
        assert {r["_parent"] for r in q[f"p5_{child}"]} <= {r["_id"] for r in q[f"p5_{parent}"]} and q[f"p5_{child}"], child
        assert len({r["_id"] for r in q[f"p5_{child}"]}) == len(q[f"p5_{child}"])
    pick = lambda name, *cols: sorted((tuple(r[c] for c in cols) for r in q[name]), key=str)
    assert pick("p5_tasks_neg", "up_task_id", "up_step_index", "_ordinal", "node_id") == [("t", 3, 0, "n"), ("t", 3, 1, "m")]
    assert pick("p5_trace_steps", "record_id", "step_index", "observation", "observation_text", "operation") == [*[("same", 0, None, None, None)] * 2, ("x", 1, None, "page", "click"), ("x", 4, "as text", None, None), ("y", 4, "as text", None, None)]
    assert pick("p5_trace_targets", "up_task_id", "up_step_index", "_ordinal", "id", "attributes_class", "value") == [
        ("x", 1, 0, "7", None, None), ("x", 1, 1, None, None, "b"), ("x", 4, 0, "a", "k", None), ("y", 4, 0, "a", "k", None),
    ]
    assert pick("p5_trace_candidates", "up_step_index", "_ordinal", "element_id", "role") == [(1, 0, "c1", "link"), (1, 1, "2", None)]
    assert pick("p5_traces", "task_id", "trajectory") == [("cut", "[{"), *[("same", None)] * 2, ("x", None), ("y", None)]
