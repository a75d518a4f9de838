"""Inference of descriptor fields, page states and instruction hints by keyword rules.

The rules are tables; ``case`` turns one into an expression that both the
engine and other SQL systems read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# fixed values: keyword tables, the first row that fits counts
SECTIONS = {
    "travel search form": "flight depart return passenger".split(),
    "result filtering panel": "filter sort brand price rating".split(),
    "checkout form": "cart checkout shipping payment".split(),
    "forum content area": "comment post reply subreddit forum".split(),
    "repository workflow area": "repository issue merge gitlab".split(),
    "navigation menu": "navigation menu section toc".split(),
    "search form": ["search"],
}
REGIONS = {
    "global header": ["header", "top nav", "global"],
    "left/sidebar control area": "sidebar filter refine".split(),
    "modal dialog": "modal dialog popup".split(),
    "footer area": ["footer"],
    "form area": "form field search checkout".split(),
}
SLOTS = {
    "origin": "from origin departure pickup source".split(),
    "destination": "to destination arrival dropoff".split(),
    "date": "date depart return calendar day".split(),
    "search_query": "search query keyword find".split(),
    "quantity": "quantity qty count number".split(),
    "price": "price budget cost".split(),
    "color": "color colour".split(),
    "size": ["size"],
    "account": "username email account login".split(),
}
CHANGES = {
    "the page updates to results, loading, or a submitted state": "search submit apply go".split(),
    "the result list reflects the selected filter or sort option": "filter sort".split(),
    "the workflow advances to the next step or confirmation state": "next continue checkout cart".split(),
    "the requested section or linked page content becomes visible": "section classification anchor link".split(),
}
DOMAINS = {
    "shopping": "buy shop product filter cart".split(),
    "travel": "flight hotel travel".split(),
    "map": "map route nearby".split(),
    "code": "issue merge repository gitlab".split(),
    "forum": "post comment reddit".split(),
}
URL_CATEGORIES = {
    "search_or_results": "search results listing list".split(),
    "cart_or_checkout": "cart checkout order".split(),
    "authentication": "login signin auth".split(),
    "code_management": "issue merge repo project".split(),
    "maps": "map route place".split(),
}
STATES = {
    "search": "search query find lookup".split(),
    "results": "result results listing list items".split(),
    "detail": "detail description overview profile".split(),
    "cart": "cart basket checkout order".split(),
    "form": "form textbox input field dropdown select".split(),
    "login": ["login", "log in", "sign in", "username", "password"],
    "confirmation": "success confirmed created submitted done".split(),
    "error": ["error", "failed", "invalid", "required", "try again"],
}
PRIORITIES = {
    "type": "field_slot parent_context placeholder accessible_name label_or_text nearby_text role",
    "select": "field_slot label_or_text accessible_name parent_context option_text role",
    "click": "parent_context role label_or_text accessible_name nearby_text region",
}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(x: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, {_q(w)})" for w in words) + ")"


def case(x: str, table: dict[str, list[str]], default: str) -> str:
    return "case " + " ".join(f"when {any_of(x, ws)} then {_q(n)}" for n, ws in table.items()) + f" else {_q(default)} end"


def slot_case(x: str, op: str) -> str:
    """The slot with most words in the text; of equal ones the first."""
    hits = {s: "(" + " + ".join(f"cast(contains({x}, {_q(w)}) as int)" for w in ws) + ")" for s, ws in SLOTS.items()}
    top = f"greatest({', '.join(hits.values())})"
    whens = " ".join(f"when {h} = {top} then {_q(s)}" for s, h in hits.items())
    return f"case when {top} = 0 then case {op} when 'type' then 'input_value' when 'select' then 'selected_option' else '' end {whens} end"


def purpose_case() -> str:
    """What an element is for, from op, slot, label_text, role and section."""
    return """case op when 'type' then case when slot <> '' then concat('enter the task-provided ', slot, ' into the ', label_text, ' field') else concat('enter task-provided text into the ', label_text, ' field') end
      when 'select' then case when slot <> '' then concat('choose the task-specified ', slot, ' option in ', section) else concat('choose the intended option for ', label_text) end
      when 'click' then case when role in ('button', 'link', 'tab', 'menuitem') then concat('activate the ', label_text, ' control in ', section) else concat('activate the task-relevant element labeled ', label_text) end
      when 'scroll' then concat('scroll within ', section, ' to reveal the next relevant controls') when 'stop' then 'finish because the task outcome is already visible'
      else concat('perform ', op, ' on the task-relevant ', label_text, ' element') end"""


def change_case(text: str) -> str:
    return f"""case op when 'type' then concat('the ', label_text, ' field contains the task-provided value')
      when 'select' then concat('the chosen ', label_text, ' option is selected and reflected in the form state')
      when 'click' then {case(text, CHANGES, 'the clicked control causes the expected task-relevant page update')}
      when 'scroll' then 'previously hidden task-relevant controls become visible' else 'the observation changes consistently with the selected operation' end"""


def source_case() -> str:
    return """case when argument is null or argument = '' then 'no argument' when slot <> '' then concat('copy task constraint for ', slot, ': ', arg)
      when has_digit then concat('numeric or date value from task: ', arg) else concat('task-provided value: ', arg) end"""


def negative_case(text: str) -> str:
    """Constraints joined by ``; ``, nulls left out by concat_ws."""
    return f"""concat_ws('; ', case when op = 'click' and contains({text}, 'search') then 'not a site-wide search button unless it belongs to the task form' end,
      case when op = 'type' then 'not a hidden field, disabled control, or unrelated newsletter/search box' end,
      case when contains({text}, 'filter') then 'not a navigation link with the same label outside the filter panel' end,
      case when contains({text}, 'more') or contains({text}, 'next') then 'not an unrelated more/next control in another card or carousel' end,
      case when contains({text}, 'checkout') or contains({text}, 'cart') then 'not a promotional link or recommendation card' end)"""


def priority_case() -> str:
    whens = " ".join(
        f"when '{op}' then case when slot = '' then {_q(p.replace('field_slot ', ''))} else {_q(p)} end" for op, p in PRIORITIES.items()
    )
    return f"case op {whens} else 'role label_or_text parent_context nearby_text' end"


def disambiguators_case() -> str:
    """At most eight hints, joined by ``; ``."""
    return """concat_ws('; ', case when role <> '' then concat('role is ', role) end, case when label <> '' then concat('primary text/name matches ', label) end,
      concat('belongs to ', section), concat('located in ', region), case when parent <> '' then concat('parent context mentions ', substring(parent, 1, 80)) end,
      case when sibling <> '' then concat('near sibling text ', substring(sibling, 1, 80)) end)"""


FIELDS = ("section", "region", "slot", "element_purpose", "expected_state_change", "value_source", "negative_constraints", "grounding_priority", "disambiguators")


def described(rows: DataFrame) -> DataFrame:
    """Descriptor fields of steps: rows need op, argument, label, role, parent and sibling, none of them null but argument."""
    x = rows.withColumn("ctx", X.normal_key(F.concat_ws(" ", "parent", "label"))).withColumn("section", F.expr(case("ctx", SECTIONS, "task-relevant content area")))
    x = x.withColumn("ctx2", X.normal_key(F.concat_ws(" ", "parent", "section", "label"))).withColumn("region", F.expr(case("ctx2", REGIONS, "main content")))
    x = x.withColumn("ctx3", X.normal_key(F.concat_ws(" ", "label", "parent", "section", "argument", "op"))).withColumn("slot", F.expr(slot_case("ctx3", "op")))
    label = F.when(F.col("label") != "", F.col("label")).when(F.col("slot") != "", F.col("slot")).otherwise(F.col("role"))
    x = x.withColumn("label_text", label).withColumn("arg", X.collapse(F.col("argument"))).withColumn("has_digit", F.col("arg").rlike("[0-9]"))
    x = x.withColumn("ctx4", X.normal_key(F.concat_ws(" ", "label_text", "section", "region"))).withColumn("ctx5", X.normal_key(F.concat_ws(" ", "role", "label", "section", "region")))
    return x.withColumns({
        "element_purpose": F.expr(purpose_case()), "expected_state_change": F.expr(change_case("ctx4")), "value_source": F.expr(source_case()),
        "negative_constraints": F.expr(negative_case("ctx5")), "grounding_priority": F.expr(priority_case()), "disambiguators": F.expr(disambiguators_case()),
    }).drop("ctx", "ctx2", "ctx3", "ctx4", "ctx5", "label_text", "arg", "has_digit")


def enriched(description: dict, inferred: dict):  # noqa: ANN201
    """Fill-only merge: fields that a descriptor has stay, the others come from the inferred columns."""
    return {k: F.coalesce(F.nullif(description[k], F.lit("")), v) if k in description else v for k, v in inferred.items()}
