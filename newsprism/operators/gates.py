"""Gates and validators: rows that break a rule, or keys that pass it.

A violation is (rule, key, detail); an empty result means that a stage's output may be stored."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _violations(*parts: tuple[str, DataFrame, Column, Column]) -> DataFrame:
    rows = [d.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail")) for rule, d, key, detail in parts]
    return reduce(DataFrame.unionByName, rows)


def same_keys(tables: Mapping[str, DataFrame], group: str, key: str) -> DataFrame:
    """Groups whose sets of keys are equal in all tables: the stages before have seen one generation.
    One shuffle by (group, key), whatever the number of tables."""
    seen = reduce(DataFrame.unionByName, [t.select(group, key).distinct().withColumn("n", F.lit(1)) for t in tables.values()])
    whole = seen.groupBy(group, key).agg((F.sum("n") == len(tables)).alias("whole"))
    return whole.groupBy(group).agg(F.bool_and("whole").alias("ok"), F.count("*").alias("keys")).where("ok").select(group, "keys")


def ranges(rows: DataFrame, key: str, unit: Sequence[str] = (), spans: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Values outside 0..1 or not finite, and spans that are empty or begin before 0."""
    parts = []
    for c in unit:
        v = F.col(c).cast("double")
        parts.append((c, rows.where(v.isNull() | F.isnan(v) | ~v.between(0.0, 1.0)), F.col(key), F.col(c)))
    for a, b in spans:
        parts.append((f"{a}-{b}", rows.where(F.col(a).isNull() | F.col(b).isNull() | (F.col(a) < 0) | (F.col(b) <= F.col(a))), F.col(key), F.concat_ws("-", a, b)))
    return _violations(*parts)


def partition(claims: DataFrame, members: DataFrame, groups: DataFrame, relations: DataFrame) -> DataFrame:
    """Groups must partition the claims.  claims (claim_id), members (group_id, claim_id), groups
    (group_id, representative_id), relations (left_group, right_group)."""
    counted = members.groupBy("claim_id").agg(F.count("*").alias("n"))
    known = groups.select("group_id")
    pair = relations.select(F.least("left_group", "right_group").alias("x"), F.greatest("left_group", "right_group").alias("y"))
    both = F.concat_ws("|", "x", "y")
    return _violations(
        ("ungrouped", claims.join(counted, "claim_id", "left_anti"), F.col("claim_id"), F.lit("")),
        ("unknown_claim", members.join(claims.select("claim_id"), "claim_id", "left_anti"), F.col("claim_id"), F.col("group_id")),
        ("in_several_groups", counted.where("n > 1"), F.col("claim_id"), F.col("n")),
        ("representative_not_member", groups.join(members.select("group_id", F.col("claim_id").alias("representative_id")), ["group_id", "representative_id"], "left_anti"), F.col("group_id"), F.col("representative_id")),
        ("related_to_itself", pair.where("x = y"), both, F.lit("")),
        ("related_twice", pair.groupBy("x", "y").count().where("count > 1"), both, F.col("count")),
        ("unknown_group", pair.select(F.explode(F.array("x", "y")).alias("group_id")).join(known, "group_id", "left_anti").distinct(), F.col("group_id"), F.lit("")),
    )


def perspectives(claims: DataFrame, rows: DataFrame) -> DataFrame:
    """claims: (claim_id, start_offset, end_offset); rows: (claim_id, kind, holder, start_offset,
    end_offset).  Every claim has one perspective, whose span holds it; a holder stands exactly with
    quoted and reported ones."""
    spans = claims.select("claim_id", F.col("start_offset").alias("c_start"), F.col("end_offset").alias("c_end"))
    joined = rows.join(spans, "claim_id")
    said = F.col("kind").isin("quoted", "reported")
    return _violations(
        ("missing", claims.join(rows, "claim_id", "left_anti"), F.col("claim_id"), F.lit("")),
        ("unknown_claim", rows.join(claims, "claim_id", "left_anti"), F.col("claim_id"), F.lit("")),
        ("several", rows.groupBy("claim_id").count().where("count > 1"), F.col("claim_id"), F.col("count")),
        ("kind", rows.where(~F.coalesce(F.col("kind").isin("quoted", "reported", "unattributed"), F.lit(False))), F.col("claim_id"), F.col("kind")),
        ("holder", rows.where(said != F.col("holder").isNotNull()), F.col("claim_id"), F.col("kind")),
        ("span", joined.where((F.col("start_offset") > F.col("c_start")) | (F.col("end_offset") < F.col("c_end"))), F.col("claim_id"), F.concat_ws("-", "start_offset", "end_offset")),
    )


def evidence(items: DataFrame, links: DataFrame, members: DataFrame) -> DataFrame:
    """items: (item, claim_id); links: (item, group_id); members: (group_id, claim_id).  One link an
    item, to the group of its claim."""
    right = items.join(members.select("claim_id", F.col("group_id").alias("own")), "claim_id")
    return _violations(
        ("unlinked", items.join(links, "item", "left_anti"), F.col("item"), F.lit("")),
        ("unknown_item", links.join(items, "item", "left_anti"), F.col("item"), F.col("group_id")),
        ("linked_twice", links.groupBy("item").count().where("count > 1"), F.col("item"), F.col("count")),
        ("wrong_group", right.join(links, "item").where("group_id <> own"), F.col("item"), F.col("group_id")),
    )


def decisions(candidates: DataFrame, answers: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """candidates: (left_group, right_group); answers: the same with relation and confidence.  Each
    candidate is decided once, in either order of its groups."""
    key = [F.least("left_group", "right_group").alias("x"), F.greatest("left_group", "right_group").alias("y")]
    asked, given = candidates.select(*key).distinct(), answers.select(*key, "relation", F.col("confidence").cast("double").alias("confidence"))
    both = F.concat_ws("|", "x", "y")
    return _violations(
        ("undecided", asked.join(given, ["x", "y"], "left_anti"), both, F.lit("")),
        ("unknown", given.join(asked, ["x", "y"], "left_anti"), both, F.col("relation")),
        ("decided_twice", given.groupBy("x", "y").count().where("count > 1"), both, F.col("count")),
        ("relation", given.where(~F.coalesce(F.col("relation").isin(*kinds), F.lit(False))), both, F.col("relation")),
        ("confidence", given.where(F.col("confidence").isNull() | F.isnan("confidence") | ~F.col("confidence").between(0.0, 1.0)), both, F.col("confidence")),
    )


def spans_match(claims: DataFrame, texts: DataFrame) -> DataFrame:
    """Claims (claim_id, article_id, start_offset, end_offset, claim_text) whose span in `texts`
    (article_id, text) no longer says them."""
    said = F.substring("text", F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
    return claims.join(texts, "article_id", "left").where(~said.eqNullSafe(F.col("claim_text"))).select("claim_id", "article_id")


def one_each(wanted: DataFrame, summaries: DataFrame, key: str) -> DataFrame:
    """Keys of `wanted` without exactly one row in `summaries`, and keys that only `summaries` has."""
    counts = summaries.groupBy(key).agg(F.count("*").alias("n"))
    both = wanted.select(key).distinct().withColumn("asked", F.lit(True)).join(counts, key, "full")
    return _violations(
        ("missing", both.where("n is null"), F.col(key), F.lit("")),
        ("several", both.where("asked and n > 1"), F.col(key), F.col("n")),
        ("unknown", both.where("asked is null"), F.col(key), F.col("n")),
    )


def canonical_json(columns: Mapping[str, Column]) -> Column:
    """Compact JSON with sorted keys, nulls kept, of scalar columns and arrays of them."""
    parts = []
    for name in sorted(columns):
        one = F.to_json(F.struct(columns[name].alias("v")), {"ignoreNullFields": "false"})
        parts.append(F.concat(F.lit(f'"{name}":'), F.substring(one, F.lit(6), F.length(one) - 6)))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def input_hash(version: str, columns: Mapping[str, Column]) -> Column:
    """Identity of a processing input: configuration version and canonical fields."""
    return F.sha2(canonical_json({**columns, "version": F.lit(version)}), 256)
