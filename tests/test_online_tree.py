"""The online memory over three levels: merging, ids, eviction with all below, stream and table alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmill.streaming import online_tree as O


def _action(i, label="Search", op="click", argument=None, problems=0):
    return {"step_index": i, "action_id": f"a{i}{label}", "op": op, "argument": argument, "fields": [["button"], [label.lower()], [], [], [], [], [], []], "problems": problems}


def _episode(n, text, stages, success=True):
    nodes = [{"stage": k, "stage_id": f"s{n}{k}", "tokens": name.split(), "actions": actions} for k, (name, actions) in enumerate(stages)]
    return {"domain": "d", "stream_index": n, "task_id": f"t{n}", "success": success, "intent_id": f"i{n}", "tokens": text.split(), "nodes": nodes}


def test_merge_evict_and_state():
    m = O.Memory()
    one = _episode(1, "book a hotel", [("fill the form", [_action(0)])])
    again = _episode(2, "book a hotel", [("fill the form", [_action(0), _action(1, "Next")]), ("read the page", [_action(2, "Read")])])
    trace = O.merge(m, [one, again, _episode(3, "x", [("s", [_action(0)])], success=False), _episode(4, "y", [])])
    got = [dict(zip(O.NAMES, r, strict=True)) for r in trace]
    assert [r["reason"] for r in got] == ["inserted", "merged", "failed", "empty"]
    assert (got[1]["known_stages"], got[1]["known_actions"], got[1]["new_stages"], got[1]["new_actions"], got[1]["duplicate_of"]) == (1, 1, 1, 2, "i1")
    # the new action went below the stage that was there, the new stage below the intent that was there
    assert {(a[0], a[1]) for a in m.actions} == {("a0Search", "s10"), ("a1Next", "s10"), ("a2Read", "s21")} and m.stages[1][1] == "i1"
    back = O.Memory(m.state())
    assert back.state() == m.state()
    late = O.merge(back, [_episode(5, "find a flight", [("s", [_action(0)])]), _episode(6, "buy shoes", [("s", [_action(0)])])], max_intents=1, protected=frozenset({"i5"}))
    assert [i for i, _ in back.intents] == ["i5"] and {p for _, p, _ in back.stages} == {"i5"} and late[1][O.NAMES.index("evicted")] == 1
    bad = _episode(7, "z", [("s", [_action(0, problems=9)])])
    assert O.merge(O.Memory(), [bad])[0][4] == "inserted"  # 0.70 without the part for transfer


def test_stream_and_table_agree_and_nothing_is_orphaned(spark, folder, tmp_path):
    import json

    step = lambda i, op, label, arg=None: {"step_index": i, "operation": op, "argument": arg, "observation": "o", "target": {"role": "button", "label_or_text": label}}
    traces = [
        {"task_id": f"t{i}", "domain": "web" if i % 2 else None, "instruction": f"search for item {i // 4}", "success": i != 3,
         "trajectory": json.dumps([step(0, "click", "Search"), step(1, "type", "Query", f"x{i}"), step(2, "click", "Apply filter")]) if i != 5 else "[{", "batch_no": 0}
        for i in range(12)
    ]
    rows = O.episodes(spark, folder(episode_traces=traces))
    want = sorted(map(tuple, O.replayed(rows, 2).collect()), key=str)
    assert len(want) == 12 and {r[4] for r in want} >= {"failed", "inserted", "merged", "empty"}
    left = O.kept(rows, 2).collect()
    ids = {(r["domain"], r["node_id"]) for r in left}
    assert all(r["parent_id"] is None or (r["domain"], r["parent_id"]) in ids for r in left)
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = O.stream(source, 2).writeStream.format("memory").queryName("online_tree").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("online_tree").collect()), key=str) == want
    O.save(O.replayed(rows, 2), O.kept(rows, 2), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/online_memory_trace")).count() == 12
    assert spark.read.json(str(tmp_path / "out/metrics")).agg(F.sum("num_tasks")).first()[0] == 12
