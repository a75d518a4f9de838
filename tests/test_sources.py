"""Sources and sinks beside the readers: orders, splits, validation with places, results, cached model calls."""

from __future__ import annotations

import json
import shutil

import pytest
from pyspark.sql import functions as F

from trailmill.operators import grounding as G
from trailmill.operators import metrics
from trailmill.sources import io


def test_orders_from_configs(spark, tmp_path):
    d = tmp_path / "configs"
    d.mkdir()
    (d / "task_12.json").write_text(json.dumps({"intent": "buy shoes", "sites": ["shopping"]}))
    (d / "gitlab_3.json").write_text(json.dumps({"intent": "open an issue"}))
    (d / "more.json").write_text(json.dumps({"tasks": [{"task_id": "9", "domain": "maps"}, {"task_id": "2", "domain": "cms"}]}))
    tasks = io.infer_tasks(io.read_records(spark, str(d), io.TASK))
    assert {(r["task_id"], r["domain"]) for r in tasks.collect()} == {("12", "shopping"), ("3", "gitlab"), ("9", "map"), ("2", "shopping_admin")}
    counts = io.write_task_order(tasks, ["map", "shopping"], str(tmp_path / "out"))
    assert {tuple(r) for r in counts.collect()} == {("map", 1), ("shopping", 1)}
    (tmp_path / "o.jsonl").write_text("\n".join(json.dumps({"task_id": str(i), "domain": "map", "order_index": str(9 - i)}) for i in range(9)))
    assert [r["task_id"] for r in io.read_task_order(spark, str(tmp_path / "o.jsonl"), "map", limit=2).collect()] == ["8", "7"]


def test_splits_fingerprints_and_results(spark, tmp_path):
    df = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", None)], "id string, s string")
    counts = io.write_splits(df, F.coalesce("s", F.lit("unknown")), str(tmp_path / "s"))
    assert {tuple(r) for r in counts.collect()} == {("train", 2), ("unknown", 1)}
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir()
    (a / "x.json").write_text("1")
    (a / "y.json").write_text("2")
    shutil.copytree(a, b)
    one = io.fingerprint(spark, str(a))
    assert one == io.fingerprint(spark, str(b))
    (b / "x.json").rename(b / "z.json")
    assert one != io.fingerprint(spark, str(b))
    tasks = spark.createDataFrame([("d", True, 3), ("d", False, 1)], "domain string, success boolean, num_steps int")
    io.write_results(df, tasks, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/metrics")).first()["task_success_rate"] == 50.0


def test_memory_files_are_checked_by_line(spark, tmp_path):
    f = tmp_path / "m.jsonl"
    lines = ['{"record_type": "intent", "intent_id": "i", "canonical_intent": "x"}', "", "{broken", '{"record_type": "stage", "stage_id": "s", "name": "n", "parent_intent_id": "", "span": [0, 1]}', '{"record_type": "other"}']
    f.write_text("\n".join(lines))
    got = {(r["line"], r["error"]) for r in io.memory_file_errors(spark, str(f)).collect()}
    assert got == {(3, "no JSON of this form"), (4, "missing parent_intent_id"), (5, "unknown record_type")}


def test_cached_calls_and_replay(spark):
    ask = spark.createDataFrame([("k1", "p1"), ("k2", "p2")], "key string, prompt string")
    cache = spark.createDataFrame([("k1", "old", "1"), ("k1", "new", "2")], "key string, answer string, written string")
    with pytest.raises(LookupError):
        io.answered(ask, cache)
    model = lambda df: df.select("key", F.upper("prompt").alias("answer"), F.lit("3").alias("written"))
    got, new = io.answered(ask, cache, model)
    assert {(r["key"], r["answer"]) for r in got.collect()} == {("k1", "new"), ("k2", "P2")} and new.count() == 1
    got, new = io.answered(ask, cache.unionByName(new))
    assert got.count() == 2 and new.count() == 0


def test_boxes_ids_and_dialects(spark):
    boxes = [
        ({"bbox": {"x": 1, "y": 2, "width": 4, "height": 6}}, (3.0, 5.0)), ({"rect": {"left": 0, "top": 0, "w": 2, "h": 2}}, (1.0, 1.0)), ({"bbox": [1, 1, 3, 5]}, (2.0, 3.0)),
        ({"bbox": [10, 10, 4, 4]}, (12.0, 12.0)), ({"bounding_box": {"center": [7, 8]}}, (7.0, 8.0)), ({"raw_candidate": {"bbox": [0, 0, 2, 2]}}, (1.0, 1.0)), ({"bbox": [1, 2]}, None), ({}, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, (b, _) in enumerate(boxes)], "i int, j string").select("i", G.centre(F.parse_json("j")).alias("c"))
    assert {r["i"]: r["c"] and tuple(r["c"]) for r in df.collect()} == {i: want for i, (_, want) in enumerate(boxes)}
    out = spark.createDataFrame([("type", "7", "hi", ['{"uid": "7", "bbox": [0, 0, 2, 2]}', '{"id": "7"}']), ("click", "8", None, ["{}"]), ("scroll", None, None, None)], "op string, target string, argument string, c array<string>")
    got = G.resolved(out.select("op", "target", "argument", F.transform(F.coalesce("c", F.array().cast("array<string>")), lambda x: F.parse_json(x)).alias("candidates"))).collect()
    assert [(r["found"], r["coordinates"], r["brackets"]) for r in got] == [(True, "type [1.0] [1.0] [hi]", "type [7] [hi]"), (False, "stop", "click [8]"), (False, "stop", "scroll [down]")]


def test_tables_are_checked(spark):
    t = spark.createDataFrame([("Full", 1.0)], "variant string, score double")
    assert metrics.checked_table(t, {"variant", "score"}, "variant", "Full").count() == 1
    for required, name in (({"variant", "gone"}, "Full"), ({"variant"}, "Other")):
        with pytest.raises(ValueError):
            metrics.checked_table(t, required, "variant", name)
