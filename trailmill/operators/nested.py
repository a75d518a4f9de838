"""Deeply nested records as related flat tables.

``flatten`` walks a schema: every array level becomes a child table whose rows
carry the surrogate key of their parent and the ordinal in the array; structs
are spread into columns, maps and scalars stay.  ``json_steps`` brings
trajectories (JSON of varying containers and types) into one array of
variants; their merged schema is inferred over all rows (``merged_schema``) and
decides which columns and child tables come out (``flatten_variants``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import table

# fixed values: names under which an element's id, a step's number and the steps may stand, in order
ID_KEYS = ("element_id", "backend_node_id", "node_id", "uid", "id", "candidate_id", "action_uid", "ref")
ATTRIBUTE_ID_KEYS = ("backend_node_id", "node_id", "id", "data_pw_testid")
STEP_KEYS = ("step_index", "index")
CONTAINERS = ("steps", "trajectory", "actions", "action_sequence", "data", "examples", "records", "tasks", "annotations")


def flatten(df: DataFrame, key: Column, name: str = "root", carry: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Flat tables of ``df`` by path: ``name``, ``name.steps``, ``name.steps.candidates`` ...

    Each has ``_id`` (surrogate key) and, but for the root, ``_parent`` and
    ``_ordinal`` (from 0).  ``key`` identifies a root row; names that clash
    after spreading structs get an underscore more.  Null and empty arrays give no child rows.
    Scalar columns named in ``carry`` (and ``_ordinal``) are handed down to all tables
    below as ``up_`` + name, so that a table can be used without joins.
    """
    out: dict[str, DataFrame] = {}

    def walk(at: DataFrame, schema: T.StructType, path: str, own: list[str]) -> None:
        cols: list[Column] = [F.col(c) for c in own]
        handed: dict[str, Column] = {c: F.col(c) for c in own if c.startswith("up_")}
        if "_ordinal" in carry and "_ordinal" in own:
            handed["up_ordinal"] = F.col("_ordinal")
        used = {c.lower() for c in own} | {"_id", "_parent", "_ordinal"}
        children: list[tuple[str, Column, T.DataType]] = []

        def spread(s: T.StructType, prefix: str, of: Column) -> None:
            for f in s.fields:
                c = of.getField(f.name)
                label = f"{prefix}{f.name}"
                if isinstance(f.dataType, T.StructType):
                    spread(f.dataType, f"{label}_", c)
                elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.StructType, T.ArrayType)):
                    children.append((label, c, f.dataType.elementType))
                else:
                    if label in carry:
                        handed[f"up_{label}"] = c
                    while label.lower() in used:
                        label += "_"
                    used.add(label.lower())
                    cols.append(c.alias(label))

        spread(schema, "", F.col("_row"))
        out[path] = at.select(*cols)
        for label, c, kind in children:
            up = [c.alias(k) for k, c in handed.items()]
            rows = at.select(F.col("_id").alias("_parent"), *up, F.posexplode(c).alias("_ordinal", "_row"))
            rows = rows.withColumn("_id", F.xxhash64(F.lit(label), "_parent", "_ordinal"))
            if isinstance(kind, T.ArrayType):  # an array in an array is a level of its own
                rows = rows.withColumn("_row", F.struct(F.col("_row").alias("items")))
                kind = T.StructType([T.StructField("items", kind)])
            walk(rows, kind, f"{path}.{label}", ["_id", "_parent", "_ordinal", *handed])

    rows = df.select(F.xxhash64(key).alias("_id"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    walk(rows, df.schema, name, ["_id"])
    return out


def _variant(v: Column | str, path: str, kind: str) -> Column:
    return F.try_variant_get(v if isinstance(v, Column) else F.col(v), path, kind)


def as_array(v: Column) -> Column:
    """A variant array as an array of variants; a single value as an array of one; null as null."""
    return F.coalesce(_variant(v, "$", "array<variant>"), F.when(v.isNotNull() & ~F.is_variant_null(v), F.array(v)))


def json_steps(text: Column) -> Column:
    """Steps of a trajectory: array<struct<pos: int, step: variant>>; unreadable text gives null.

    The steps may be an array, lie in a container, be an object by position,
    or any of these as a JSON string.
    """
    v = F.try_parse_json(text)
    inner = F.try_parse_json(_variant(v, "$", "string"))
    v = F.when(_variant(v, "$", "array<variant>").isNull() & _variant(v, "$", "map<string,variant>").isNull(), inner).otherwise(v)
    held = F.coalesce(*[_variant(v, f"$.{k}", "variant") for k in CONTAINERS])
    held = F.coalesce(F.when(_variant(v, "$", "array<variant>").isNull(), held), v)
    listed = F.transform(_variant(held, "$", "array<variant>"), lambda x, i: F.struct(i.alias("pos"), x.alias("step")))
    keyed = F.map_entries(_variant(held, "$", "map<string,variant>"))
    keyed = F.filter(keyed, lambda e: e["key"].rlike(r"^\d{1,9}$"))
    keyed = F.transform(keyed, lambda e: F.struct(e["key"].cast("int").alias("pos"), e["value"].alias("step")))
    return F.coalesce(listed, keyed)


def merged_schema(rows: DataFrame, col: str) -> T.DataType:
    """The schema that holds every value of a variant column, inferred over all rows in one aggregation.

    Paths at which kinds conflict are variants in it; no rows give an empty struct.
    """
    return _parsed(rows.agg(F.schema_of_variant_agg(F.col(col)).alias("s")).first()["s"])


def _parsed(ddl: str | None) -> T.DataType:
    ddl = re.sub(r"\bOBJECT\b(?=<)", "STRUCT", ddl or "VOID").replace("OBJECT<>", "STRUCT<>")
    if ddl in ("VOID", "STRUCT<>"):
        return T.StructType([])
    return T._parse_datatype_string(ddl)


def _at(v: Column, path: tuple[str, ...]) -> Column:
    for n in path:
        v = _variant(v, f"$['{n}']" if "'" not in n else f'$["{n}"]', "variant")
    return v


def layout(rows: DataFrame, col: str) -> tuple[list[tuple[str, ...]], list[tuple[str, ...]]]:
    """Paths of the text columns and of the child tables of a variant column of objects.

    Objects are spread.  Where kinds conflict at a path, an array among them
    makes it a child table (other values are arrays of one); objects beside
    scalars are spread beside a column of the scalars.  One aggregation a
    level of conflicts.
    """
    texts: list[tuple[str, ...]] = []
    tables: list[tuple[str, ...]] = []

    def walk(schema: T.DataType, path: tuple[str, ...]) -> list[tuple[str, ...]]:
        mixed = []
        for f in schema.fields if isinstance(schema, T.StructType) else ():
            p = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                mixed += walk(f.dataType, p)
            elif isinstance(f.dataType, T.VariantType):
                mixed.append(p)
            else:
                (tables if isinstance(f.dataType, T.ArrayType) else texts).append(p)
        return mixed

    mixed = walk(merged_schema(rows, col), ())
    while mixed:
        aggs = []
        for i, p in enumerate(mixed):
            v = _at(F.col(col), p)
            array, obj = _is(v, "array<variant>"), _is(v, "map<string,variant>")
            scalar = v.isNotNull() & ~F.is_variant_null(v) & ~array & ~obj
            aggs += [F.max(array).alias(f"a{i}"), F.max(scalar).alias(f"s{i}"), F.schema_of_variant_agg(F.when(obj, v)).alias(f"o{i}")]
        r, found, mixed = rows.agg(*aggs).first(), mixed, []
        for i, p in enumerate(found):
            if r[f"a{i}"]:
                tables.append(p)
                continue
            if r[f"s{i}"]:
                texts.append(p)
            mixed += walk(_parsed(r[f"o{i}"]), p)
    return sorted(texts), sorted(tables)


def _is(v: Column, kind: str) -> Column:
    return _variant(v, "$", kind).isNotNull()


def flatten_variants(rows: DataFrame, name: str, only: str | None = None) -> dict[str, DataFrame]:
    """Flat tables of a column ``_row`` of variants by path, as ``flatten`` gives them; scalars are text.

    ``rows``: ``_row``, ``_id`` and further columns, which stand in the table of
    ``name``; those that begin with ``up_`` are handed down.  An element that is no object stands
    in ``value``.  ``only`` is the path of the one table asked for: the schemas of others are not inferred.
    """
    out: dict[str, DataFrame] = {}

    def walk(at: DataFrame, path: str) -> None:
        own = [c for c in at.columns if c != "_row"]
        texts, tables = layout(at, "_row")
        if only is None or only == path:
            used, cols = {c.lower() for c in own} | {"_id", "_parent", "_ordinal"}, []
            for p in texts:
                label, v = "_".join(p), _at(F.col("_row"), p)
                while label.lower() in used:
                    label += "_"
                used.add(label.lower())
                nested_ = _is(v, "array<variant>") | _is(v, "map<string,variant>")
                cols.append(F.when(~nested_, _variant(v, "$", "string")).alias(label))
            out[path] = at.select(*own, *cols)
        for p in tables:
            below = f"{path}.{'_'.join(p)}"
            if only is None or only == below or only.startswith(f"{below}."):
                up = [F.col(c) for c in own if c.startswith("up_")]
                down = at.select(F.col("_id").alias("_parent"), *up, F.posexplode(as_array(_at(F.col("_row"), p))).alias("_ordinal", "_row"))
                down = down.withColumn("_id", F.xxhash64(F.lit("_".join(p)), "_parent", "_ordinal"))
                lone = F.to_variant_object(F.struct(F.col("_row").alias("value")))
                walk(down.withColumn("_row", F.when(_is(F.col("_row"), "map<string,variant>"), F.col("_row")).otherwise(lone)), below)

    walk(rows, name)
    return out


def id_of(get) -> Column:  # noqa: ANN001
    """The first id of an element that is neither null nor empty; ``get(path)`` gives text."""
    paths = [*ID_KEYS, *[f"attributes.{k}" for k in ATTRIBUTE_ID_KEYS]]
    return F.coalesce(*[F.nullif(get(p), F.lit("")) for p in paths if get(p) is not None], F.lit(None).cast("string"))


def _has(schema: T.DataType, path: str) -> bool:
    """Whether a merged schema may hold ``path``; below a variant anything may stand."""
    for name in path.split("."):
        if isinstance(schema, T.VariantType):
            return True
        if isinstance(schema, T.ArrayType):
            schema = schema.elementType
        if not isinstance(schema, T.StructType) or name not in schema.names:
            return isinstance(schema, T.VariantType)
        schema = schema[name].dataType
    return True


def trace_steps(traces: DataFrame) -> DataFrame:
    """_parent (task_id), _ordinal, step_index and the step as a variant."""
    rows = traces.where(F.col("task_id").isNotNull()).select("task_id", F.explode(json_steps(F.col("trajectory"))).alias("s"))
    rows = rows.select(F.col("task_id").alias("_parent"), F.col("s.pos").alias("_ordinal"), F.col("s.step").alias("step"))
    rows = rows.where(_variant("step", "$", "map<string,variant>").isNotNull())
    return rows.withColumn("step_index", _step_number("step"))


def _step_number(step: str) -> Column:
    return F.coalesce(*[_variant(step, f"$.{k}", "int") for k in STEP_KEYS], F.col("_ordinal"))


def trace_elements(steps: DataFrame, schema: T.DataType | None = None) -> DataFrame:
    """_parent, step_index and element_id of every target; only ids that the merged schema holds are looked for."""
    t = steps.select("_parent", "step_index", F.explode(as_array(_variant("step", "$.target", "variant"))).alias("t"))

    def get(path: str) -> Column | None:
        known = schema is None or _has(schema, f"target.{path}")
        return _variant("t", f"$.{path}", "string") if known else None

    return t.select("_parent", "step_index", id_of(get).alias("element_id")).where(F.col("element_id").isNotNull())


def _root_key(rows: DataFrame) -> Column:
    """Key of a row of records: a redelivered row is a root of its own; rows equal in all columns are numbered."""
    plain = [F.to_json(F.col(f"`{c}`")) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, t in rows.dtypes]
    content = F.xxhash64(*plain, *[c.isNull() for c in plain])
    return F.struct("task_id", content, F.row_number().over(W.partitionBy(content).orderBy(content)))


def trace_tables(traces: DataFrame, only: str | None = None) -> dict[str, DataFrame]:
    """Flat tables of traces: ``traces``, ``traces.steps``, ``traces.steps.target`` and what else the steps hold.

    ``traces`` keeps the text of a trajectory only where it cannot be read as steps.
    """
    rows = traces.where(F.col("task_id").isNotNull())
    rows = rows.withColumn("_id", F.xxhash64(_root_key(rows))).withColumn("_steps", json_steps(F.col("trajectory")))
    root = rows.withColumn("trajectory", F.when(F.col("_steps").isNull(), F.col("trajectory"))).select("_id", *traces.columns)
    if only == "traces":
        return {"traces": root}
    steps = rows.select(F.col("_id").alias("_parent"), F.col("task_id").alias("up_task_id"), F.explode("_steps").alias("s"))
    steps = steps.select("_parent", "up_task_id", F.col("s.pos").alias("_ordinal"), F.col("s.step").alias("_row")).where(_is(F.col("_row"), "map<string,variant>"))
    steps = steps.withColumn("_id", F.xxhash64(F.lit("steps"), "_parent", "_ordinal")).withColumn("up_step_index", _step_number("_row"))
    return {"traces": root, **flatten_variants(steps, "traces.steps", only)}


def task_tables(tasks: DataFrame) -> dict[str, DataFrame]:
    """Flat tables of tasks; a redelivered row is a root of its own."""
    rows = tasks.where(F.col("task_id").isNotNull())
    return flatten(rows, _root_key(rows), "tasks", carry=("task_id", "step_index", "_ordinal"))


def task_elements(tasks: DataFrame) -> DataFrame:
    """_parent (task_id), step_index and element_id of every pos_candidate."""
    e = task_tables(tasks.select("task_id", "loaded_at", "steps"))["tasks.steps.pos_candidates"]

    def get(path: str) -> Column | None:
        if path in e.columns and path not in ("_id", "_parent", "_ordinal"):
            return F.col(path).cast("string")
        return F.col("attributes")[path.split(".")[1]] if path.startswith("attributes.") and "attributes" in e.columns else None

    step = F.coalesce("up_step_index", "up_ordinal").alias("step_index")
    out = e.select(F.col("up_task_id").alias("_parent"), step, id_of(get).alias("element_id"))
    return out.where(F.col("element_id").isNotNull())


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_found: each distinct link from a record through a step to an element it acted on.

    Null record ids give no row.
    """
    links = lambda t, name: t.select(F.lit(name).alias("table_name"), F.col("_parent").alias("record_id"), "step_index", "element_id")
    a = task_elements(table(spark, sf_dir, "tasks"))
    steps = trace_steps(table(spark, sf_dir, "episode_traces").select("task_id", "trajectory"))
    b = trace_elements(steps, merged_schema(steps, "step"))
    return links(a, "tasks").unionByName(links(b, "episode_traces")).distinct()


def task_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_task_steps: the steps of tasks as a flat table, with the task they belong to."""
    return task_tables(table(spark, sf_dir, "tasks"))["tasks.steps"].drop("_id", "_parent")


def trace_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_trace_steps: the steps of traces with their links and all fields but arrays, as text, whatever kinds they mix."""
    t = trace_tables(table(spark, sf_dir, "episode_traces"), "traces.steps")["traces.steps"]
    t = t.drop(*[c for c in t.columns if c.lower() in STEP_KEYS])
    return t.withColumnsRenamed({"up_task_id": "record_id", "up_step_index": "step_index"})


def trace_part(path: str):  # noqa: ANN201
    """A query of one table of traces; without such parts in the data it has no rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        none = spark.createDataFrame([], "_parent long, up_task_id string, up_step_index int, _ordinal int, _id long")
        return trace_tables(table(spark, sf_dir, "episode_traces"), path).get(path, none)

    return run


def task_part(path: str):  # noqa: ANN201
    """A query of one table of tasks, with its links."""
    return lambda spark, sf_dir: task_tables(table(spark, sf_dir, "tasks"))[path]
