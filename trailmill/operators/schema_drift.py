"""Schemas that drift between files: a catalogue of the lifespans of fields.

``catalogue`` is the footer metadata of JSON files: per feed, file and path the
number of values of each type, pre-aggregated in each Arrow batch before it is
shuffled.  Lifespans of a path are islands over the files of its feed
(``lag`` over the file number); their starts and endings are the changes.  A
start and an ending of the same field in the same object in one file, under
names that the alias table or another spelling make equal, are a rename.

``unified`` reads every record into one table of steps; its casts follow from
the same alias table.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut, table

# fixed values: names under which producers write the same field, by the object that holds it
ALIASES = {
    "record": (
        ("annotation_id", "task_id", "id", "episode_id"),
        ("confirmed_task", "raw_instruction", "instruction", "task", "query"),
        ("website", "site"),
        ("actions", "action_sequence", "trajectory", "steps"),
        ("action_reprs", "action_representations"),
    ),
    "step": (
        ("operation", "op", "action_type"),
        ("value", "argument", "text", "input"),
        ("cleaned_html", "html"),
        ("action_uid", "uid"),
        ("step_index", "index"),
        ("action_repr", "repr"),
        ("pos_candidates", "positive_candidates", "gold_candidates"),
        ("neg_candidates", "negative_candidates"),
    ),
    "candidate": (
        ("backend_node_id", "element_id", "node_id", "uid", "id", "candidate_id", "action_uid", "ref"),
        ("tag", "tag_name"),
        ("text", "visible_text", "inner_text", "label", "label_or_text"),
        ("accessible_name", "aria_label", "name"),
        ("parent_context", "context", "ancestors"),
        ("sibling_text", "sibling_context", "nearby_text"),
        ("bbox", "bounding_box", "rect"),
        ("dom_path", "xpath", "css_selector", "selector", "path"),
        ("relative_position", "position"),
    ),
}
OPAQUE = frozenset({"attributes"})
_CANON = {kind: {name: names[0] for names in groups for name in names} for kind, groups in ALIASES.items()}
_BELOW = {("record", "actions"): "step", ("step", "pos_candidates"): "candidate", ("step", "neg_candidates"): "candidate"}
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def spelling(name: str) -> str:
    """A name in one spelling: snake case."""
    return re.sub(r"[\s\-_]+", "_", _CAMEL.sub("_", name)).lower().strip("_")


def canonical_name(kind: str, name: str) -> str:
    s = spelling(name)
    return _CANON.get(kind, {}).get(s, s)


def _type(v: object) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def _read(payload: str | None) -> dict | None:
    """A record, or None for null, blank, cut-off and non-object lines."""
    try:
        v = json.loads(payload) if payload else None
    except ValueError:
        return None
    return v if isinstance(v, dict) else None


def fields(record: dict) -> set[tuple[str, str, str, str]]:
    """(path, type, canonical parent, canonical name) of every field with a value."""
    out: set[tuple[str, str, str, str]] = set()

    def walk(v: object, path: str, canon: str, kind: str) -> None:
        if isinstance(v, dict):
            for name, x in v.items():
                if x is None:
                    continue
                cname = canonical_name(kind, name)
                at = f"{path}.{name}" if path else name
                out.add((at, _type(x), canon, cname))
                if name not in OPAQUE:
                    walk(x, at, f"{canon}.{cname}" if canon else cname, _BELOW.get((kind, cname), "other"))
        elif isinstance(v, list):
            for x in v:
                if isinstance(x, (dict, list)):
                    walk(x, f"{path}[]", f"{canon}[]", kind)

    walk(record, "", "", "record")
    return out


def catalogue(records: DataFrame) -> DataFrame:
    """feed, file_no, file_name, path, type, parent, name and n (records with such a value) of every file.

    A file without a readable record has one row with a null path.
    Rows without a feed or file number belong to no file and are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n: Counter = Counter()
            for feed, no, name, payload in pdf.itertuples(index=False):
                n[(feed, no, name, None, None, None, None)] += 0
                if (r := _read(payload)) is not None:
                    n.update((feed, no, name, *f) for f in fields(r))
            yield pd.DataFrame(
                [(*k, v) for k, v in n.items()], columns=["feed", "file_no", "file_name", "path", "type", "parent", "name", "n"]
            )

    rows = records.where(F.col("feed").isNotNull() & F.col("file_no").isNotNull()).select("feed", "file_no", "file_name", "payload")
    part = rows.mapInPandas(
        run, "feed string, file_no int, file_name string, path string, type string, parent string, name string, n long"
    )
    by = ["feed", "file_no", "path", "type", "parent", "name"]
    return part.groupBy(*by).agg(F.sum("n").alias("n"), F.min("file_name").alias("file_name"))


def typed(cat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row a feed, file and path, with the type of most values (first by name on a tie) and the file's place ``seq``."""
    most = F.max_by("type", F.struct("n", (-F.ascii("type")).alias("t"))).alias("type")
    paths = cat.where(F.col("path").isNotNull()).groupBy("feed", "file_no", "path").agg(most, F.min("parent").alias("parent"), F.min("name").alias("name"))
    files = cat.groupBy("feed", "file_no").agg(F.min("file_name").alias("file_name"))
    files = files.withColumn("seq", F.row_number().over(W.partitionBy("feed").orderBy("file_no")))
    files = cut(files.withColumn("last", F.max("seq").over(W.partitionBy("feed"))))
    return paths.join(files.select("feed", "file_no", "seq", "last"), ["feed", "file_no"]), files


def lifespans(rows: DataFrame) -> DataFrame:
    """feed, path, type, first and last place of every island of files in which a path has one type."""
    w = W.partitionBy("feed", "path").orderBy("seq")
    new = (F.lag("seq").over(w) != F.col("seq") - 1) | (F.lag("type").over(w) != F.col("type"))
    isle = rows.withColumn("isle", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w))
    return isle.groupBy("feed", "path", "parent", "name", "isle", "type", "last").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")).drop("isle")


def _ancestors(path: Column) -> Column:
    """Paths of the fields that hold a field."""
    parts = F.split(path, r"\.")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.regexp_replace(F.array_join(F.slice(parts, 1, i), "."), r"(\[\])+$", ""))
    return F.when(F.size(parts) > 1, up).otherwise(F.array().cast("array<string>"))


def changes(records: DataFrame) -> DataFrame:
    """feed, seq, file_name, change_kind, old_path, new_path, old_type, new_type of every file against the one before."""
    rows, files = typed(cut(catalogue(records)))
    spans = cut(lifespans(rows))
    w = W.partitionBy("feed", "path").orderBy("first_seq")
    s = spans.withColumn("before_last", F.lag("last_seq").over(w)).withColumn("before_type", F.lag("type").over(w))
    s = s.withColumn("after_first", F.lead("first_seq").over(w))
    start = s.where(F.col("first_seq") > 1)
    follows = F.col("before_last") == F.col("first_seq") - 1
    retyped = start.where(follows).select("feed", F.col("first_seq").alias("seq"), F.lit("retyped").alias("kind"), F.col("path").alias("old_path"), F.col("path").alias("new_path"), F.col("before_type").alias("old_type"), F.col("type").alias("new_type"))
    key = ["feed", "seq", "parent", "name"]
    added = start.where(~F.coalesce(follows, F.lit(False))).select("feed", F.col("first_seq").alias("seq"), "parent", "name", F.col("path").alias("new_path"), F.col("type").alias("new_type"))
    ends = (F.col("last_seq") < F.col("last")) & ~F.coalesce(F.col("after_first") == F.col("last_seq") + 1, F.lit(False))
    removed = s.where(ends).select("feed", (F.col("last_seq") + 1).alias("seq"), "parent", "name", F.col("path").alias("old_path"), F.col("type").alias("old_type"))
    nth = lambda c: F.row_number().over(W.partitionBy(*key).orderBy(c))
    both = added.withColumn("nth", nth("new_path")).join(removed.withColumn("nth", nth("old_path")), [*key, "nth"], "full")
    kind = F.when(F.col("old_path").isNull(), "added").when(F.col("new_path").isNull(), "removed").otherwise("renamed")
    events = both.select("feed", "seq", kind.alias("kind"), "old_path", "new_path", "old_type", "new_type").unionByName(retyped)
    events = cut(events)
    # a field within a field that itself changed in the file is not reported
    changed = events.select("feed", "seq", F.explode(F.array_distinct(F.array_compact(F.array("old_path", "new_path")))).alias("up")).distinct()
    up = F.explode(F.array_union(F.coalesce(_ancestors(F.col("old_path")), F.array().cast("array<string>")), F.coalesce(_ancestors(F.col("new_path")), F.array().cast("array<string>")))).alias("up")
    within = events.select("feed", "seq", "kind", "old_path", "new_path", up).join(changed, ["feed", "seq", "up"])
    within = within.select("feed", "seq", "kind", F.coalesce("old_path", F.lit("")).alias("o"), F.coalesce("new_path", F.lit("")).alias("p")).distinct()
    e = events.withColumn("o", F.coalesce("old_path", F.lit(""))).withColumn("p", F.coalesce("new_path", F.lit("")))
    e = e.join(within, ["feed", "seq", "kind", "o", "p"], "left_anti").join(files.select("feed", "seq", "file_name"), ["feed", "seq"])
    return e.select("feed", "seq", "file_name", F.col("kind").alias("change_kind"), F.col("o").alias("old_path"), F.col("p").alias("new_path"), "old_type", "new_type")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_records")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p3_found: file_name, change_kind, old_path, new_path."""
    return changes(_records(spark, sf_dir)).select("file_name", "change_kind", "old_path", "new_path")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p3_lifespans: first and last file number of every stretch of files in which a field has one type."""
    rows, files = typed(cut(catalogue(_records(spark, sf_dir))))
    of = lambda c, n: files.select("feed", F.col("seq").alias(c), F.col("file_no").alias(n))
    s = lifespans(rows).drop("last").join(of("first_seq", "first_file"), ["feed", "first_seq"]).join(of("last_seq", "last_file"), ["feed", "last_seq"])
    return s.select("feed", "path", "type", "first_file", "last_file")


# --- one table -----------------------------------------------------------------
RECORD_COLUMNS = {
    "annotation_id": "task_id string", "confirmed_task": "instruction string", "website": "website string", "domain": "domain string",
    "subdomain": "subdomain string", "success": "success boolean", "recorded_at": "recorded_at timestamp_ntz",
    "locale": "locale string", "difficulty": "difficulty string", "viewport": "viewport string", "num_steps": "num_steps int",
}
STEP_COLUMNS = {
    "step_index": "step_index int", "operation": "operation string", "value": "value string", "action_uid": "action_uid string",
    "action_repr": "action_repr string", "url": "url string", "cleaned_html": "cleaned_html string",
    "confidence": "confidence double", "screenshot": "screenshot string",
}
TEXT_KEYS = ("text", "op", "value", "name")  # fixed values: names in an object under which the text of a field stands
ELEMENTS = ("pos_candidates", "neg_candidates")


def _json(v: object) -> str:
    return json.dumps(v, sort_keys=True, ensure_ascii=False)


def _text(v: object) -> str | None:
    """The text in a value of any type: of an array all that it holds, of an object that under text or op."""
    if isinstance(v, list):
        v = [x for x in v if x is not None]
        if any(isinstance(x, (list, dict)) for x in v) and len(v) > 1:
            return _json(v)
        v = " ".join(map(_text, v)) if len(v) > 1 else v[0] if v else None
    if isinstance(v, dict):
        v = next((v[k] for k in TEXT_KEYS if v.get(k) is not None), _json(v))
    if isinstance(v, (list, dict)):
        return _json(v)
    return None if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def _beside(name: str, v: object, kept: object) -> dict[str, str]:
    """What the column of a field does not hold of its value ``v``: parts of an object, parts of an array, what could not be cast."""
    if isinstance(v, list) and len(v) == 1:
        v = v[0]
    if v is not None and kept is None or isinstance(v, list) and len(v) > 1:
        return {name: _json(v) if isinstance(v, (list, dict)) else _text(v)}
    if isinstance(v, dict):
        own = next((k for k in TEXT_KEYS if v.get(k) is not None), None)
        return {f"{name}.{k}": _json(x) if isinstance(x, (list, dict)) else _text(x) for k, x in v.items() if own and k != own and x is not None}
    return {}


def _cast(v: object, kind: str) -> object:
    t = _text(v)
    if t is None or kind == "string":
        return t
    if kind == "int":
        try:
            return int(float(t))
        except (ValueError, OverflowError):
            return None
    if kind == "double":
        try:
            return float(t)
        except ValueError:
            return None
    if kind == "boolean":
        return {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}.get(t.strip().lower())
    try:
        at = pd.Timestamp(int(t), unit="ms") if t.strip().lstrip("-").isdigit() else pd.Timestamp(t)
        return at.tz_localize(None) if at.tzinfo is None else at.tz_convert("UTC").tz_localize(None)
    except (ValueError, OverflowError):
        return None


def _by_name(obj: dict, kind: str) -> dict[str, object]:
    """The values by canonical name; of several names of one field the first counts, and the others stay under their own."""
    out: dict[str, object] = {}
    order = _CANON.get(kind, {})
    for name, v in sorted(obj.items(), key=lambda x: list(order).index(spelling(x[0])) if spelling(x[0]) in order else 99):
        if v is not None:
            cname = canonical_name(kind, name)
            out.setdefault(name if cname in out else cname, v)
    return out


def _many(v: object) -> list:
    return list(v) if isinstance(v, list) else [] if v is None else [v]


def _places(v: object) -> list:
    """An array, or an object by place, in order; anything else is an array of one."""
    if isinstance(v, dict) and v and all(k.isdecimal() for k in v):
        return [v[k] for k in sorted(v, key=int)]
    if isinstance(v, dict) and v and all(isinstance(x, dict) for x in v.values()):
        return list(v.values())
    return _many(v)


def _reprs(v: object, n: int) -> list:
    """The descriptions of ``n`` steps: an array, or one text ``a | b``, in which a label may hold the bar too."""
    if not isinstance(v, str):
        return _places(v)
    cuts = [re.split(r"\s+\|\s+(?=\[)", v), re.split(r"\s+\|\s+", v)]
    return next((c for c in cuts if len(c) == n), cuts[0] if v.lstrip().startswith("[") else cuts[1])


def _row(obj: dict, columns: dict[str, str], used: tuple[str, ...] = ()) -> tuple[list, dict[str, str]]:
    """The values of the columns, and all else that an object by name holds, as text."""
    vals = [_cast(obj.get(k), c.split()[1]) for k, c in columns.items()]
    rest: dict[str, str] = {}
    for k, x in zip(columns, vals, strict=True):
        rest |= _beside(k, obj.get(k), x)
    return vals, rest | {k: _json(v) if isinstance(v, (list, dict)) else _text(v) for k, v in obj.items() if k not in columns and k not in used}


def _elements(v: object) -> list[dict[str, str]]:
    return [_row(_by_name(c, "candidate") if isinstance(c, dict) else {"value": c}, {})[1] for c in _many(v) if c is not None]


def unified(records: DataFrame) -> DataFrame:
    """Every readable record as rows of steps with the same columns and types, whatever its file wrote.

    A record without steps is one row with a null ``step_pos``.  Repeated
    lines stay rows of their own.  What no column holds stands as text in
    ``record_fields`` and ``step_fields``, by canonical name: fields not
    listed, parts of objects and arrays, and values that cannot be cast (null
    in their column).  Candidates are maps of their fields.
    """
    head = ["feed", "file_name", "file_no", "line_no"]
    columns = [*RECORD_COLUMNS.values(), "record_fields map<string,string>", "step_pos int", *STEP_COLUMNS.values(), "n_pos int", "n_neg int"]
    columns += [*[f"{k} array<map<string,string>>" for k in ELEMENTS], "step_fields map<string,string>"]
    schema = "feed string, file_name string, file_no int, line_no int, " + ", ".join(columns)
    names = [*head, *[c.split()[0] for c in columns]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for *at, payload in pdf.itertuples(index=False):
                if (r := _read(payload)) is None:
                    continue
                rec = _by_name(r, "record")
                steps = [(i, s) for i, s in enumerate(_places(rec.get("actions"))) if s is not None]
                steps = [(i, _by_name(s if isinstance(s, dict) else {"step": s}, "step")) for i, s in steps]
                reprs = _reprs(rec.get("action_reprs"), len(steps))
                placed = {i for i, s in steps if i < len(reprs) and s.get("action_repr", reprs[i]) == reprs[i]}
                own, more = _row(rec, RECORD_COLUMNS, ("actions", "action_reprs") if len(placed) == len(reprs) else ("actions",))
                for i, step in steps:
                    step.setdefault("step_index", i)
                    if "action_repr" not in step and i < len(reprs):
                        step["action_repr"] = reprs[i]
                    vals, rest = _row(step, STEP_COLUMNS, ELEMENTS)
                    pos, neg = (_elements(step.get(k)) for k in ELEMENTS)
                    rows.append((*at, *own, more, i, *vals, len(pos), len(neg), pos, neg, rest))
                if not steps:
                    rows.append((*at, *own, more, *[None] * (len(STEP_COLUMNS) + 6)))
            out = pd.DataFrame(rows, columns=names)
            for c in ("step_pos", "step_index", "n_pos", "n_neg", "num_steps"):
                out[c] = out[c].astype("Int32")
            out["confidence"] = out["confidence"].astype("Float64")
            out["recorded_at"] = pd.to_datetime(out["recorded_at"])
            out["success"] = out["success"].astype("boolean")
            yield out

    return records.select(*head, "payload").mapInPandas(run, schema)


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p3_steps: the one table of tasks and steps."""
    return unified(_records(spark, sf_dir))
