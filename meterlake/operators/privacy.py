"""Minimisation of attribute bags: a first deletion by pattern, and a last one by profile. Expressions only, no shuffle.

An error in an expression fails the query instead of letting a row through, so nothing here uses a ``try_`` function.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.operators import privacy_names as names

PROFILES = ("core", "evaluation", "corporate")


@cache
def quick(pattern: str) -> str:
    """The same matches, found faster: the alternatives of the last outer group that is an alternation of words (or, without one, of
    the whole pattern) are grouped by their first letter, so that most are passed over by one comparison. Others stay as they are."""
    found = re.fullmatch(r"(\(\?i\))(\(\^\|[^()]*\))?\((.*?)\)(\((?:\[._-\]|\\\.)\|\$\))?", pattern)
    if not found:
        return pattern
    flag, before, body, after = found.groups()
    depth, words, start = 0, [], 0
    for at, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return pattern
        if c == "|" and depth == 0:
            words.append(body[start:at])
            start = at + 1
    words.append(body[start:])
    if depth or not all(re.match(r"[a-z](?![?*+{])", w) for w in words):
        return pattern
    letters = sorted({w[0] for w in words})
    each = "|".join(f"{c}(?:{'|'.join(w[1:] for w in words if w[0] == c)})" for c in letters)
    return f"{flag}{(before or '').replace('(', '(?:', 1)}(?:{each}){(after or '').replace('(', '(?:', 1)}"


def delete_matching_keys(bag: Column, pattern: str) -> Column:
    """The bag without keys in which ``pattern`` is found."""
    if pattern == names.EVERYTHING:
        return F.map_filter(bag, lambda k, _: F.lit(False))
    return F.map_filter(bag, lambda k, _: ~k.rlike(quick(pattern)))


def delete_keys(bag: Column, keys) -> Column:
    return F.map_filter(bag, lambda k, _: ~k.isin(*keys))


def keep_keys(bag: Column, keys) -> Column:
    return F.map_filter(bag, lambda k, _: k.isin(*keys))


def delete_key_where(bag: Column, key: str, condition: Column) -> Column:
    return F.when(condition, delete_keys(bag, [key])).otherwise(bag)


def _scope(df: DataFrame, change) -> Column:
    return F.named_struct(F.lit("name"), F.col("scope.name"), F.lit("version"), F.col("scope.version"), F.lit("attributes"), change(F.col("scope.attributes")))


def _events(change, name=None) -> Column:
    def one(e: Column) -> Column:
        e = e.withField("attributes", change(e["attributes"]))
        return e.withField("name", F.lit(name)) if name else e

    return F.transform("events", one)


def initial(df: DataFrame, signal: str, profile: str = "core") -> DataFrame:
    """First stage over flat ``df`` of ``signal`` (logs, spans or points): deletes sensitive keys by pattern."""
    corporate = profile == "corporate"
    if signal == "points":
        resource, scope, record = names.INITIAL_METRIC, names.EVERYTHING, names.INITIAL_METRIC
    else:
        resource = names.CORPORATE_RESOURCE if corporate else names.INITIAL_RESOURCE
        scope = names.EVERYTHING if corporate else names.INITIAL_SCOPE
        record = names.CORPORATE_RECORD if corporate else names.INITIAL_RECORD
    out = df.withColumns({
        "resource": delete_matching_keys(F.col("resource"), resource),
        "scope": _scope(df, lambda b: delete_matching_keys(b, scope)),
        "attributes": delete_matching_keys(F.col("attributes"), record),
    })
    return out.withColumn("events", _events(lambda b: delete_matching_keys(b, names.INITIAL_EVENT))) if signal == "spans" else out


def final(df: DataFrame, signal: str, profile: str = "core") -> DataFrame:
    """Last stage: metrics keep listed keys in every profile; traces and logs lose keys by name and pattern, or in the
    corporate profile keep listed ones and have their names replaced. Texts become constants."""
    corporate = profile == "corporate"
    nothing = lambda b: delete_matching_keys(b, names.EVERYTHING)
    if signal == "points":
        point_keys = [k for k in names.POINT_KEYS if not (corporate and k in names.CORPORATE_POINT_DROPS)]
        out = df.withColumns({
            "resource": keep_keys(F.col("resource"), names.METRIC_RESOURCE_KEYS), "scope": _scope(df, nothing),
            "description": F.lit(""), "attributes": keep_keys(F.col("attributes"), point_keys),
        })
        return out.where(~F.col("metric").isin(*names.CONTENT_SIZE_METRICS)) if corporate else out
    if corporate:
        resource = lambda b: keep_keys(b, names.CORPORATE_RESOURCE_KEYS)
        scope, record = nothing, lambda b: keep_keys(b, names.CORPORATE_RECORD_KEYS)
    else:
        resource = scope = record = lambda b: F.map_filter(b, lambda k, _: ~(k.isin(*names.FINAL_KEYS) | k.rlike(quick(names.FINAL))))
    out = df.withColumns({"resource": resource(F.col("resource")), "scope": _scope(df, scope), "attributes": record(F.col("attributes"))})
    if signal == "logs":
        return out.withColumn("body", F.lit(names.LOG_BODY))
    out = out.withColumns({"status_message": F.lit(""), "trace_state": F.lit(""), "events": _events(record, names.EVENT_NAME if corporate else None)})
    return out.withColumn("name", F.lit(names.SPAN_NAME)) if corporate else out
