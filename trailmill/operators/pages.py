"""Pages as rows of elements: HTML and accessibility trees as table functions over Arrow batches.

HTML has no built-in parser in the engine, so both are ``mapInPandas``
functions: rows are parsed where they stand, without a shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

# fixed values: tags and roles
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DROPPED = frozenset("script style noscript template".split())
CONTROLS = frozenset("a button input select textarea option summary label".split())
CONTAINERS = frozenset("main section article aside nav header footer form fieldset div ul ol li table tr td th label p span h1 h2 h3 h4".split())
TAG_ROLES = {"a": "link", "select": "combobox", "textarea": "textbox", "nav": "navigation", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading"}
INPUT_ROLES = {"submit": "button", "button": "button", "reset": "button", "image": "button", "checkbox": "checkbox", "radio": "radio", "range": "slider", "search": "searchbox"}
CLICKABLE = frozenset("button link menuitem checkbox radio option tab switch".split())
EDITABLE = frozenset("textbox combobox searchbox spinbutton".split())
ELEMENT = "index int, role string, tag string, text string, name string, value string, path string, parent_context string, clickable boolean, editable boolean"
COLUMNS = [c.split()[0] for c in ELEMENT.split(", ")]


class _Page(HTMLParser):
    """Collects elements; void tags close at once, an end tag closes up to its start tag."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[dict] = []
        self.out: list[dict] = []
        self.counts: list[dict[str, int]] = [{}]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        n = self.counts[-1][tag] = self.counts[-1].get(tag, 0) + 1
        above = self.stack[-1] if self.stack else {"path": "", "hidden": False}
        style = a.get("style", "").replace(" ", "").lower()
        hidden = above["hidden"] or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style or tag in DROPPED
        context = " / ".join(f["tag"] + (f" {f['label']}" if f["label"] else "") for f in self.stack[-4:])
        f = {"tag": tag, "attrs": a, "texts": [], "hidden": hidden, "label": a.get("aria-label") or a.get("title") or "", "parent": context, "at": len(self.out), "path": f"{above['path']}/{tag}[{n}]"}
        self.out.append(f)
        if tag not in VOID:
            self.stack.append(f)
            self.counts.append({})

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if any(f["tag"] == tag for f in self.stack):
            while self.stack:
                self.counts.pop()
                if self.stack.pop()["tag"] == tag:
                    break

    def handle_data(self, data: str) -> None:
        t = " ".join(data.split())
        if t:
            for f in self.stack:
                f["texts"].append(t)


def role_of(tag: str, attrs: dict) -> str:
    if attrs.get("role"):
        return attrs["role"].strip().lower()
    return INPUT_ROLES.get(attrs.get("type", "text").lower(), "textbox") if tag == "input" else TAG_ROLES.get(tag, tag)


def html_elements(html: str | None) -> list[tuple]:
    """Visible controls and text containers of a page in document order; repeated layout texts once; nothing for null."""
    if not html:
        return []
    p = _Page()
    p.feed(html)
    p.close()
    rows, seen = [], set()
    for f in p.out:
        if f["hidden"]:
            continue
        tag, a = f["tag"], f["attrs"]
        role, text = role_of(tag, a), " ".join(f["texts"])
        control = tag in CONTROLS or role in CLICKABLE or role in EDITABLE or "onclick" in a
        if "disabled" in a and not control:
            continue
        if not control and (tag not in CONTAINERS or not text or (role, text) in seen):
            continue
        if not control:
            seen.add((role, text))
        name = next((a[k] for k in ("aria-label", "title", "alt", "placeholder", "name") if a.get(k)), text)
        edit = role in EDITABLE
        rows.append((len(rows), role, tag, text, name, a.get("value", ""), f["path"], f["parent"][:160], control and not edit, edit))
    return rows


def tree_elements(text: str | None) -> list[tuple]:
    """Nodes of an accessibility tree (JSON) in pre-order; invisible nodes are left out, their children visited; unreadable gives none."""
    try:
        root = json.loads(text) if text else None
    except ValueError:
        return []
    rows: list[tuple] = []
    todo = [(root, "root", ())]
    while todo:  # a stack of its own: trees may be deeper than the interpreter's
        node, path, above = todo.pop()
        if isinstance(node, list):
            todo += [(c, f"{path}_{i}", above) for i, c in reversed(list(enumerate(node)))]
            continue
        if not isinstance(node, dict):
            continue
        role, name, value = (str(node.get(k) or "") for k in ("role", "name", "value"))
        if node.get("visible", True) and (role or name or value):
            edit = bool(node.get("editable", role in EDITABLE))
            rows.append((len(rows), role, "", str(node.get("text") or name), name, value, path, " / ".join(above[-4:]), bool(node.get("clickable", role in CLICKABLE)), edit))
        inner = (*above, f"{role}:{name}".strip(":")) if role or name else above
        todo += [(c, f"{path}_{i}", inner) for i, c in reversed(list(enumerate(node.get("children") or [])))]
    return rows


def exploded(pages: DataFrame, key: str, col: str, parse: Callable[[str | None], list[tuple]] = html_elements) -> DataFrame:
    """One row an element of every page: ``key`` and the element columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *e) for k, page in pdf.itertuples(index=False) for e in parse(page)]
            yield pd.DataFrame(rows, columns=[key, *COLUMNS])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, col).mapInPandas(run, f"`{key}` {kind}, {ELEMENT}")


def recorded_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and html of every step of the raw records that holds markup."""
    from .schema_drift import unified

    s = unified(table(spark, sf_dir, "raw_records")).where(F.col("cleaned_html").isNotNull())
    return s.select(F.concat_ws("#", "file_name", "line_no", "step_pos").alias("page_id"), F.col("cleaned_html").alias("html"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of all recorded pages."""
    return exploded(recorded_html(spark, sf_dir), "page_id", "html")


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by role and tag, with how many act on a click or take text."""
    e = elements(spark, sf_dir)
    return e.groupBy("role", "tag").agg(F.count("*").alias("n"), F.sum(F.col("clickable").cast("int")).alias("clickable"), F.sum(F.col("editable").cast("int")).alias("editable"))
