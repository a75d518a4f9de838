"""Queries on pages, streams and caches, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import episodes as E
from ..operators import pages
from ..sources import io
from ..session import table
from ..streaming import online, online_tree
from .episode_queries import STEPS


def _cache(s, d):  # noqa: ANN001, ANN202
    """Steps as requests against the answers of the first half of the tasks' steps."""
    st = E.steps(s, d).select("task_id", "pos", io.prompt_key(F.lit("m"), F.col("operation"), F.lit("json"), F.coalesce("label", F.lit(""))).alias("key"))
    cache = st.where(F.col("pos") % 2 == 0).select("key", F.col("pos").alias("answer"), F.concat_ws("#", "task_id", F.col("pos").cast("string")).alias("written"))
    hits, misses = io.cache_lookup(st, cache)
    return hits.select("task_id", "pos", "key", F.lit(True).alias("hit")).unionByName(misses.select("task_id", "pos", "key", F.lit(False).alias("hit")))


def queries() -> dict:
    return {
        "html_elements": pages.elements,
        "html_summary": pages.summary,
        "online_gate": online.gate_report,
        "online_trace": lambda s, d: online.replayed(online.episodes(s, d)),
        "online_tree": lambda s, d: online_tree.replayed(online_tree.episodes(s, d)),
        "online_tree_memory": lambda s, d: online_tree.kept(online_tree.episodes(s, d)),
        "online_prefix_counts": lambda s, d: online.prefix_counts(online.episodes(s, d)),
        "event_windows": lambda s, d: online.event_windows(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))),
        "prompt_cache": _cache,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "online_prefix_counts": """with f as (select task_id, coalesce(domain, 'unknown') as domain, coalesce(success, false)::int as s, coalesce(loaded_at, timestamp '9999-12-31') as t0 from
            (select *, row_number() over (partition by task_id order by coalesce(loaded_at, timestamp '9999-12-31'), domain nulls first, instruction nulls first, success nulls first) as rn from episode_traces where task_id is not null) where rn = 1),
          n as (select *, row_number() over (partition by domain order by t0, task_id) as stream_index from f)
          select domain, stream_index, task_id, coalesce(sum(s) over w - s, 0)::bigint as before, (sum(s) over w)::bigint as after, true as no_leak from n window w as (partition by domain order by stream_index)""",
        "event_windows": "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as value from events group by 1, 2",
        "prompt_cache": f"""with {STEPS}, k as (select task_id, pos, sha256(concat_ws(chr(1), 'm', operation, 'json', coalesce(label, ''))) as key from st)
          select task_id, pos, key, key in (select key from k where pos % 2 = 0) as hit from k""",
    }
