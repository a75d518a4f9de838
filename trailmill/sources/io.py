"""Readers and writers of the record files: JSON lines, JSON documents, CSV, memory files, task orders, configs."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.metrics import run_metrics
from ..operators.states import DOMAIN_WORDS, domain_name
from ..session import cut

# fixed values: keys under which a document may hold its records
CONTAINERS = ("data", "examples", "records", "tasks", "annotations", "order")
SOURCE = "struct<dataset:string,episode_id:string,step_index:int>"
DESCRIPTION = (
    "struct<" + ",".join(f"{f}:string" for f in (
        "role", "label_or_text", "accessible_name", "element_purpose", "parent_context", "sibling_context", "nearby_text", "form_section",
        "relative_position", "field_slot", "value_source", "input_value_type", "expected_state_change"))
    + ",disambiguators:array<string>,negative_constraints:array<string>,grounding_priority:array<string>>"
)
MEMORY = (
    "record_type string, format_version string, intent_id string, canonical_intent string, constraints array<struct<slot:string,value:string,evidence:string>>, domain_hint string, "
    f"stage_id string, parent_intent_id string, name string, span array<int>, pre_conditions array<string>, post_conditions array<string>, stage_type string, completion_signals array<string>, "
    f"transfer_rationale string, action_id string, parent_stage_id string, operation string, argument_template string, semantic_description {DESCRIPTION}, source {SOURCE}"
)
LEVELS = {"intent": ("intent_id", "canonical_intent"), "stage": ("stage_id", "name", "parent_intent_id"), "action": ("action_id", "operation", "parent_stage_id")}


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, keep_bad: bool = False) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped.

    A malformed line fails the read, or with ``keep_bad`` comes out as a row
    with its text in ``_bad`` (``quarantine`` parts them).
    """
    if not keep_bad:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    full = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).add("_bad", "string")
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("_file"))
    record = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select(record.alias("r"), "_file").select("r.*", "_file")


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of a read with ``keep_bad``; the bad ones keep their file."""
    return rows.where(F.col("_bad").isNull()).drop("_bad", "_file"), rows.where(F.col("_bad").isNotNull()).select("_bad", F.col("_file").alias("file"))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every record below a folder: JSON documents (a list, a container object, or one record) and JSON lines, with ``_file``."""
    parts = []
    lines = spark.read.text(path, pathGlobFilter="*.jsonl", recursiveFileLookup=True)
    parts.append(lines.where(F.trim("value") != "").select(F.array("value").alias("r"), F.col("_metadata.file_path").alias("_file")))
    docs = spark.read.text(path, pathGlobFilter="*.json", recursiveFileLookup=True, wholetext=True).select(F.try_parse_json("value").alias("v"), F.col("_metadata.file_path").alias("_file"))
    listed = F.try_variant_get("v", "$", "array<variant>")
    held = F.coalesce(listed, *[F.try_variant_get("v", f"$.{k}", "array<variant>") for k in CONTAINERS], F.array("v"))
    parts.append(docs.select(F.transform(held, lambda x: F.to_json(x)).alias("r"), "_file"))
    rows = parts[0].unionByName(parts[1]).select(F.explode("r").alias("r"), "_file")
    return rows.select(F.from_json("r", schema).alias("r"), "_file").select("r.*", "_file")


def write_jsonl(df: DataFrame, path: str) -> None:
    """One record a line with sorted keys; null fields are left out."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def write_json(data: object, path: str) -> None:
    """A small driver-side document, sorted and indented."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(data, indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n", encoding="utf-8")


def merge(base: dict, over: dict) -> dict:
    """Deep merge: values of ``over`` win, objects are merged."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def expand(value: object) -> object:
    """``${NAME}`` in texts from the environment; unknown names stay."""
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], m[0]), value)
    if isinstance(value, dict):
        return {k: expand(v) for k, v in value.items()}
    return [expand(v) for v in value] if isinstance(value, list) else value


def read_config(path: str) -> dict:
    """A JSON (or, where a YAML library is installed, YAML) config with its ``extends`` chain."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        data = yaml.safe_load(text) or {}
    else:
        data = json.loads(text)
    up = data.pop("extends", None)
    base = read_config(str(Path(path).parent / up)) if up else {}
    return expand(merge(base, data))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """method, domain, task_sr from CSV; the later row of a method and domain wins; a missing column is an error."""
    df = spark.read.csv(path, header=True)
    if missing := {"method", "domain", "task_sr"} - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    rows = df.select(F.trim("method").alias("method"), F.trim("domain").alias("domain"), F.col("task_sr").cast("double").alias("task_sr"), F.monotonically_increasing_id().alias("ord"))
    return rows.groupBy("method", "domain").agg(F.max_by("task_sr", "ord").alias("task_sr"))


def require(df: DataFrame, *fields: str) -> DataFrame:
    """``df``, once no row lacks one of ``fields``; else an error that names one."""
    bad = df.where(" or ".join(f"`{f}` is null" for f in fields)).limit(1).collect()
    if bad:
        raise ValueError(f"missing fields in {bad[0].asDict()}")
    return df


def memory_errors(rows: DataFrame, name: str | None = None) -> DataFrame:
    """record_type, record (its id, or the column ``name``) and error of every row of a memory file that breaks its form."""
    kind = F.col("record_type")
    checks = [F.when(~F.coalesce(kind.isin(*LEVELS), F.lit(False)), F.lit("unknown record_type"))]
    for k, need in LEVELS.items():
        checks += [F.when((kind == k) & F.coalesce(F.col(f) == "", F.lit(True)), F.lit(f"missing {f}")) for f in need]
    checks.append(F.when((kind == "stage") & (F.coalesce(F.size("span"), F.lit(0)) != 2), F.lit("span is not a pair")))
    record = F.col(name) if name else F.coalesce("intent_id", "stage_id", "action_id")
    return rows.select("record_type", record.alias("record"), F.explode(F.array_compact(F.array(*checks))).alias("error"))


def load_memory(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """intents, stages and actions of a memory file, in any order of its lines; an unknown type or missing parent is an error."""
    rows = read_jsonl(spark, path, MEMORY)
    if bad := memory_errors(rows).limit(1).collect():
        raise ValueError(f"{bad[0]['error']} in {bad[0]['record_type']} {bad[0]['record']}")
    of = lambda k: rows.where(F.col("record_type") == k)
    i, s, a = of("intent"), of("stage"), of("action")
    up = lambda df, key, parent: df.select(F.col(key).alias(parent))
    lost = s.select("stage_id", "parent_intent_id").join(up(i, "intent_id", "parent_intent_id"), "parent_intent_id", "left_anti").select("stage_id").limit(1).collect()
    lost = lost or a.select("action_id", "parent_stage_id").join(up(s, "stage_id", "parent_stage_id"), "parent_stage_id", "left_anti").select("action_id").limit(1).collect()
    if lost:
        raise ValueError(f"missing parent of {lost[0][0]}")
    return {"intents": i, "stages": s, "actions": a}


def save_memory(tree: dict[str, DataFrame], path: str) -> None:
    """The three levels as one file of records."""
    t = tree["intents"].unionByName(tree["stages"], allowMissingColumns=True).unionByName(tree["actions"], allowMissingColumns=True)
    write_jsonl(t, path)


def task_order(rows: DataFrame, domain: str | None = None) -> DataFrame:
    """Tasks of a domain in order: by numeric order index, then by text; a missing index is the task id."""
    if domain is not None:
        rows = rows.where(F.col("domain") == domain)
    key = F.coalesce(F.col("order_index").cast("string"), F.col("task_id").cast("string"))
    return rows.orderBy(F.coalesce(key.try_cast("bigint"), F.lit(2**62)), key)


def with_config(tasks: DataFrame, configs: DataFrame) -> DataFrame:
    """Tasks with the fields of their config file under them: the task's own value wins."""
    both = [c for c in configs.columns if c in tasks.columns and c != "config_file"]
    c = configs.select("config_file", *[F.col(x).alias(f"_c_{x}") for x in configs.columns if x != "config_file"])
    out = tasks.join(c, "config_file", "left")
    for x in configs.columns:
        if x != "config_file":
            out = out.withColumn(x, F.coalesce(x, f"_c_{x}") if x in both else F.col(f"_c_{x}")).drop(f"_c_{x}")
    return out


def materialized_order(tasks: DataFrame, domains: list[str]) -> DataFrame:
    """order_index of tasks by domain (in the given order), numeric id, id and file."""
    rank = F.lit(len(domains))
    for i, d in enumerate(domains):
        rank = F.when(F.col("domain") == d, i).otherwise(rank)
    num = F.coalesce(F.col("task_id").try_cast("bigint"), F.lit(2**62))
    w = W.partitionBy("domain").orderBy(num, "task_id", "config_file")
    return tasks.withColumns({"domain_rank": rank, "order_index": F.row_number().over(w) - 1})


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and sha256 of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def fingerprint(spark: SparkSession, path: str) -> str:
    """One hash of a folder's file names and contents, whatever their order: hashes of files are summed where they stand."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath()
    rel = F.regexp_replace("path", f"^[a-z0-9]+:/*{re.escape(root.lstrip('/'))}/?", "")
    one = F.sha2(F.concat_ws("\0", rel, "sha256"), 256)
    parts = [F.sum(F.conv(F.substring(one, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"h{i}") for i in range(4)]
    r = file_hashes(spark, path).agg(F.count("*").alias("n"), *parts).first()
    return hashlib.sha256("|".join(str(v) for v in r).encode()).hexdigest()


def write_splits(df: DataFrame, split: Column, path: str) -> DataFrame:
    """Records partitioned by split below ``path``/records, with their counts beside them in ``path``/counts; returns the counts."""
    df.withColumn("split", split).write.mode("overwrite").partitionBy("split").json(f"{path}/records")
    counts = df.groupBy(split.alias("split")).agg(F.count("*").alias("records"))
    counts.coalesce(1).write.mode("overwrite").json(f"{path}/counts")
    return df.sparkSession.read.schema("split string, records long").json(f"{path}/counts")


TASK = "task_id string, domain string, order_index string, intent string, config_file string, sites array<string>"


def read_task_order(spark: SparkSession, path: str, domain: str | None = None, limit: int | None = None) -> DataFrame:
    """Tasks of an order file or folder (lists, containers or JSON lines), in order; ``limit`` ends a run early."""
    rows = task_order(read_records(spark, path, TASK).drop("_file"), domain)
    return rows if limit is None else rows.limit(limit)


def infer_tasks(configs: DataFrame) -> DataFrame:
    """task_id and domain of task configs (``read_records`` with ``_file``): their own, else the digits or name of the file, and what sites, file and text speak of."""
    stem = F.regexp_extract("_file", r"([^/]+?)(\.[^./]*)?$", 1)
    digits = F.regexp_extract(stem, r"(\d+)", 1)
    task = F.coalesce(F.nullif(F.trim("task_id"), F.lit("")), F.nullif(digits, F.lit("")), stem)
    text = F.concat_ws(" ", F.concat_ws(" ", "sites"), "_file", "intent")
    named = F.coalesce(F.nullif(F.trim("domain"), F.lit("")), F.get(F.coalesce("sites", F.array().cast("array<string>")), F.lit(0)))
    hint = F.coalesce(*[F.when(F.contains(F.lower(text), F.lit(w)), n) for n, ws in DOMAIN_WORDS.items() for w in ws], F.lit("unknown"))
    return configs.withColumns({"task_id": task, "domain": F.when(named.isNotNull(), domain_name(named)).otherwise(hint), "config_file": F.coalesce("config_file", "_file")})


def write_task_order(tasks: DataFrame, domains: list[str], path: str) -> DataFrame:
    """``materialized_order`` of the tasks of ``domains`` as JSON lines below ``path``/order, with counts in ``path``/counts; returns the counts."""
    rows = materialized_order(tasks.where(F.col("domain").isin(*domains)), domains)
    rows.orderBy("domain_rank", "order_index").drop("domain_rank").write.mode("overwrite").json(f"{path}/order")
    counts = rows.groupBy("domain").agg(F.count("*").alias("tasks"))
    counts.coalesce(1).write.mode("overwrite").json(f"{path}/counts")
    return tasks.sparkSession.read.schema("domain string, tasks long").json(f"{path}/counts")


def memory_file_errors(spark: SparkSession, path: str) -> DataFrame:
    """file, line, error of every line of memory files that is no record of its form; blank lines are skipped.

    A file is read whole, so that its lines can be numbered.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("at", "text"))
    rows = files.where(F.trim("text") != "").withColumn("r", F.from_json("text", T._parse_datatype_string(MEMORY).add("_bad", "string"), {"columnNameOfCorruptRecord": "_bad"}))
    where = F.concat_ws(":", "file", (F.col("at") + 1).cast("string"))
    bad = rows.where(F.col("r._bad").isNotNull()).select(F.col("file"), (F.col("at") + 1).alias("line"), F.lit("no JSON of this form").alias("error"))
    good = rows.where(F.col("r._bad").isNull()).select("r.*", where.alias("_at")).drop("_bad")
    found = memory_errors(good, "_at")
    place = F.regexp_extract("record", r"^(.*):(\d+)$", 1), F.regexp_extract("record", r":(\d+)$", 1).cast("int")
    return bad.unionByName(found.select(place[0].alias("file"), place[1].alias("line"), "error"))


def write_results(steps: DataFrame, tasks: DataFrame, path: str) -> None:
    """Predictions of steps, results of tasks and their metrics, each below ``path``."""
    steps.write.mode("overwrite").json(f"{path}/predictions")
    tasks.write.mode("overwrite").json(f"{path}/task_results")
    run_metrics(tasks).coalesce(1).write.mode("overwrite").json(f"{path}/metrics")


def prompt_key(model: Column, name: Column, form: Column, prompt: Column) -> Column:
    """Key of a cached answer."""
    return F.sha2(F.concat_ws("\u0001", model, name, form, prompt), 256)


def cache_lookup(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answered requests, misses) by ``key``; of several answers under a key the last ``written`` counts."""
    last = cache.groupBy("key").agg(F.max_by("answer", "written").alias("answer"))
    return requests.join(last, "key"), requests.join(last, "key", "left_anti")


def answered(requests: DataFrame, cache: DataFrame, model: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(``requests`` with answers, answers to add to the cache): cached ones first, the rest from ``model``.

    ``model`` takes the requests missed and returns key, answer and written,
    such as a ``mapInPandas`` that calls a model batch by batch.  Without one
    the run is a replay, and a miss is an error.
    """
    hits, misses = cache_lookup(requests, cache)
    if model is None:
        if lost := misses.limit(1).collect():
            raise LookupError(f"no cached answer for {lost[0]['key']}")
        return hits, cache.limit(0)
    new = cut(model(misses))
    return hits.unionByName(misses.join(new.select("key", "answer"), "key")), new
