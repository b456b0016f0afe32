"""Scalar functions: safe text and numbers, digests and ids, canonical JSON, sizes, classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that each exporter lets through, and its greatest length.
STATUS_TEXT, STATUS_CHARS = r"[^A-Za-z0-9_.:/() +\-]", 160
HOOK_TEXT, HOOK_CHARS = r"[^A-Za-z0-9_.:/+\-]", 80
#: Upper bounds of the byte-size histogram.
SIZE_BOUNDS = (256, 1024, 4096, 16384, 65536, 262144)


def safe_text(value: Column, fallback: str = "unknown", refuse: str = STATUS_TEXT, length: int = STATUS_CHARS) -> Column:
    """Null or blank: the fallback; other characters become underscores; cut to ``length``."""
    trimmed = F.trim(value.cast("string"))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(fallback)).otherwise(F.substring(F.regexp_replace(trimmed, refuse, "_"), 1, length))


def safe_int(value: Column, default: int = 0) -> Column:
    """A whole number from a text, number or boolean; anything else is the default."""
    return F.coalesce(value.try_cast("bigint"), F.lit(default).cast("bigint"))


def safe_float(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(default))


def is_true(value: Column) -> Column:
    """Truth of an environment text: 1, true, yes or on."""
    return F.coalesce(F.lower(F.trim(value)).isin("1", "true", "yes", "on"), F.lit(False))


def present(value: Column) -> Column:
    """Not null and not blank."""
    return F.coalesce(F.trim(value) != "", F.lit(False))


def utf8_size(value: Column) -> Column:
    return F.octet_length(value).cast("bigint")


def trace_id(key: Column, suffix: Column) -> Column:
    """32 hex digits that are the same in every run for one key and suffix."""
    return F.substring(F.sha2(F.concat(F.lit("trace:"), key, F.lit(":"), suffix), 256), 1, 32)


def span_id(key: Column, suffix: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit("span:"), key, F.lit(":"), suffix), 256), 1, 16)


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA-256 in hex, by hashing the padded key and the message twice; the key is a constant of the session."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), message.cast("string").cast("binary")), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)


def pseudonym(value: Column, key: bytes, digits: int = 24) -> Column:
    return F.substring(hmac_sha256(value, key), 1, digits)


def canonical_json(value: Column) -> Column:
    """Compact JSON with sorted keys of a JSON text; a text that isn't JSON is measured as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(value)), value)


def one_hot(value: Column, bounds=SIZE_BOUNDS) -> Column:
    """Bucket counts of one value: len(bounds) + 1 numbers, one of them 1; a bound belongs to its bucket."""
    at = F.size(F.filter(F.array(*(F.lit(float(b)) for b in bounds)), lambda b: b < value))
    return F.transform(F.sequence(F.lit(0), F.lit(len(bounds))), lambda i: (i == at).cast("bigint"))


def clamp(value: Column, low: float, high: float) -> Column:
    """Within [low, high]; null stays null, though least and greatest would skip it."""
    return F.when(value.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), value)))


def clamp_min(value: Column, low: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(low), value))


def round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def duration_ms(start_ns: Column, end_ns: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.call_function("div", end_ns - start_ns, F.lit(1_000_000)))


def url_base(url: Column) -> Column:
    """An endpoint without its signal path and closing slashes."""
    return F.regexp_replace(F.regexp_replace(url, r"/+$", ""), r"/v1/(?:traces|metrics|logs)$", "")


def is_loopback(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^https?://(\[[^\]]*\]|[^:/?#]+)", 1)).isin("localhost", "127.0.0.1", "[::1]"), F.lit(False))


def key_value(text: Column) -> tuple[Column, Column]:
    """(key, value) of ``key=value``, split at the first equals sign."""
    return F.substring_index(text, "=", 1), F.regexp_extract(text, r"^[^=]*=(.*)$", 1)


def is_logical_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[a-z0-9][a-z0-9_.-]{0,63}$"), F.lit(False))


def is_hex_id(value: Column, digits: int) -> Column:
    return F.coalesce(value.rlike(f"^[0-9a-f]{{{digits}}}$"), F.lit(False))


# Tools of the turn protocol and their categories; the categories of the status line.
TOOL_CATEGORIES = {"Bash": "execution", "apply_patch": "editor", "Agent": "agent-collaboration", "spawn_agent": "agent-collaboration", "send_message": "agent-collaboration", "wait_agent": "agent-collaboration"}
STATUS_CATEGORIES = ("file-operation", "search-operation", "execution-operation", "agent-collaboration", "interaction-operation", "other-tool")


def hook_tool_category(tool: Column, known=TOOL_CATEGORIES) -> Column:
    """Category of a known tool; tools of connectors have a prefix; others are "other"."""
    named = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))[tool]
    return F.coalesce(named, F.when(tool.startswith("mcp__"), "connector"), F.lit("other"))


def listed_category(category: Column, known=STATUS_CATEGORIES) -> Column:
    return F.when(category.isin(*known), category).otherwise("other-tool")


def outcome(error: Column) -> Column:
    return F.when(present(error), "error").otherwise("success")


def error_category(error: Column) -> Column:
    return F.when(present(error), "tool_error")


def thresholds(value: Column, steps: list[tuple[float, str]], base: str) -> Column:
    """The name of the greatest step that ``value`` reaches, or ``base``."""
    out = F.when(value.isNull(), None)
    for step, name in sorted(steps, reverse=True):
        out = out.when(value >= step, name)
    return out.otherwise(base)
