"""Query templates in SQL that both engines run: {name} is a table of the model, @f(...) a function
that the engines spell differently."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from newsprism.plans.oracle import prelude
from newsprism.sources.model import Model

_ONE = r"\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)"
_SPARK = (
    (rf"@sha{_ONE}", r"sha2(\1, 256)"),
    (rf"@set{_ONE}", r"array_join(array_sort(collect_set(\1)), ',')"),
    (rf"@size{_ONE}", r"size(\1)"),
    (rf"@int{_ONE}", r"cast(\1 as bigint)"),
    (rf"@real{_ONE}", r"cast(\1 as double)"),
    (rf"@floor{_ONE}", r"cast(floor(\1) as bigint)"),
    (rf"@matches{_ONE}", r"regexp_like(\1)"),
    (r"@nl\b", r"'\\n'"),
)
_OTHER = (
    (rf"@sha{_ONE}", r"sha256(\1)"),
    (rf"@set{_ONE}", r"coalesce(array_to_string(list_sort(list(DISTINCT \1) FILTER (WHERE \1 IS NOT NULL)), ','), '')"),
    (rf"@size{_ONE}", r"len(\1)"),
    (rf"@int{_ONE}", r"cast(\1 as bigint)"),
    (rf"@real{_ONE}", r"cast(\1 as double)"),
    (rf"@floor{_ONE}", r"cast(floor(\1) as bigint)"),
    (rf"@matches{_ONE}", r"regexp_matches(\1)"),
    (r"@nl\b", r"chr(10)"),
)
DRIVER = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


def _spelled(sql: str, rules: tuple[tuple[str, str], ...]) -> str:
    for pattern, to in rules:
        while re.search(pattern, sql):
            sql = re.sub(pattern, to, sql)
    return sql


def tables_of(sql: str) -> set[str]:
    return set(re.findall(r"\{([a-z_]+)\}", sql))


def run(model: Model, sql: str) -> DataFrame:
    """The template over the model's tables, planned by Catalyst as one query."""
    names = tables_of(sql)
    frames = {n: model.table(n) if n in DRIVER else getattr(model, n) for n in names}
    return model.spark.sql(_spelled(sql, _SPARK), **frames)


def oracle(sql: str) -> str:
    """The template as standalone SQL for the other engine."""
    names = tables_of(sql)
    body = _spelled(re.sub(r"\{([a-z_]+)\}", lambda m: "embeddings_" if m[1] == "embeddings" else m[1], sql), _OTHER)
    parts = prelude(names)
    if "embeddings" in names:
        parts = ", ".join(x for x in (parts, "embeddings_ AS (SELECT vec_id AS article_id, embedding, label FROM embeddings)") if x)
    if not parts:
        return body
    if body.strip()[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {parts}, {body.strip()[15:]}"
    return f"WITH {parts}, {body.strip()[5:]}" if body.strip()[:5].upper() == "WITH " else f"WITH {parts} {body}"


