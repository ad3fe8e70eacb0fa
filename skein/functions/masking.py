"""Masking and clipping as Catalyst expressions.

Three classes of credential-shaped text are replaced by `[masked:<class>:<length>:<sha256 prefix>]`, in this order:
assignments, prefixed tokens, and long runs of high diversity. Masking is idempotent. All of it stays in the JVM but
the deep masking of arbitrary JSON, which one Arrow UDF does.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes of the three classes. `(?U)` gives Java the Unicode word boundary.
ASSIGNMENT = r"\b[A-Z][A-Z0-9_]{2,}=[A-Za-z0-9+/=_-]{16,}"
TOKEN = r"\b[a-z]{2,7}-[A-Za-z0-9_-]{20,}"
ENTROPY = r"[A-Za-z0-9+/=_-]{40,}"
CLASSES = (("assignment", ASSIGNMENT), ("token", TOKEN), ("entropy", ENTROPY))
CAP = 65536  # UTF-16 units of a text
DEPTH = 4  # containers of `extra` that survive
DISTINCT, GROUPS = 16, 3


def java(pattern: str) -> str:
    return pattern.replace(r"\b", r"(?U:\b)")


def dense(hit: Column) -> Column:
    """Whether a run has 16 different characters and three of lower, upper, digit and symbol."""
    kinds = sum((hit.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", "[+/=_-]")), F.lit(0))
    return (F.size(F.array_distinct(F.split(hit, ""))) >= DISTINCT) & (kinds >= GROUPS)


def marker(kind: str, hit: Column) -> Column:
    return F.concat(F.lit(f"[masked:{kind}:"), F.length(hit).cast("string"), F.lit(":"), F.substring(F.sha2(hit, 256), 1, 8), F.lit("]"))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def replaced(text: Column, kind: str, pattern: str) -> Column:
    mark = (lambda h: F.when(dense(h), marker(kind, h)).otherwise(h)) if kind == "entropy" else (lambda h: marker(kind, h))

    def joined(t: Column) -> Column:
        hits = F.transform(F.regexp_extract_all(t, F.lit(java(pattern)), F.lit(0)), mark)
        pieces = F.zip_with(F.split(t, java(pattern), -1), hits, lambda gap, hit: F.array(gap, F.coalesce(hit, F.lit(""))))
        return F.array_join(F.flatten(pieces), "")

    return bound(text, lambda t: F.when(t.rlike(java(pattern)), joined(t)).otherwise(t))


def suspect(text: Column) -> Column:
    """Whether any class has a hit: one look at a text, which most texts end with."""
    return text.rlike("|".join(f"(?:{java(pattern)})" for _, pattern in CLASSES))


def mask(text: Column) -> Column:
    out = text
    for kind, pattern in CLASSES:
        out = replaced(out, kind, pattern)
    return F.when(suspect(text), out).otherwise(text)


def mask_counts(text: Column) -> dict[str, Column]:
    """How many hits of each class mask() replaces."""
    out, masked = {}, text
    for kind, pattern in CLASSES:
        hits = F.regexp_extract_all(masked, F.lit(java(pattern)), F.lit(0))
        found = F.size(F.filter(hits, dense) if kind == "entropy" else hits).cast("long")
        out[kind] = F.when(suspect(text), found).when(text.isNotNull(), F.lit(0).cast("long"))
        masked = replaced(masked, kind, pattern)
    return out


def clip(text: Column, cap: int = CAP) -> Column:
    """The text up to `cap` UTF-16 units; a surrogate pair is never split."""

    def cut(raw: Column) -> Column:
        high = F.conv(F.hex(F.substring(raw, 2 * cap - 1, 1)), 16, 10).cast("int").between(0xD8, 0xDB)
        return F.decode(F.substring(raw, F.lit(1), F.when((F.octet_length(raw) > 2 * cap) & high, 2 * cap - 2).otherwise(2 * cap)), "UTF-16BE")

    # so many code points are so many units at least: what follows them is not encoded
    return bound(text, lambda t: F.when(F.length(t) <= cap // 2, t).otherwise(bound(F.encode(F.substring(t, 1, cap), "UTF-16BE"), cut)))


def mask_value(text: str) -> str:
    """mask() and clip() for one string inside of `extra`."""
    for kind, pattern in CLASSES:

        def mark(m: re.Match, kind: str = kind) -> str:
            hit = m[0]
            if kind == "entropy" and (len(set(hit)) < DISTINCT or sum(bool(re.search(p, hit)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[+/=_-]")) < GROUPS):
                return hit
            return f"[masked:{kind}:{len(hit)}:{hashlib.sha256(hit.encode()).hexdigest()[:8]}]"

        text = re.sub(pattern, mark, text)
    raw = text.encode("utf-16-be")
    return text if len(raw) <= 2 * CAP else raw[: 2 * CAP - 2 * (0xD8 <= raw[2 * CAP - 2] <= 0xDB)].decode("utf-16-be")


def mask_deep(value: Any, depth: int = DEPTH) -> Any:
    """Every string value masked; containers below the fourth become null; keys stay."""
    if isinstance(value, str):
        return mask_value(value)
    if isinstance(value, (dict, list)):
        if depth == 0:
            return None
        return {k: mask_deep(v, depth - 1) for k, v in value.items()} if isinstance(value, dict) else [mask_deep(v, depth - 1) for v in value]
    return value


def mask_extra(extra: Column) -> Column:
    """Deep masking of a JSON object as text; what is no object becomes {}."""

    def one(text: str | None) -> str:
        try:
            value = json.loads(text or "{}")
        except ValueError:
            value = {}
        return json.dumps(mask_deep(value if isinstance(value, dict) else {}), ensure_ascii=False, separators=(",", ":"))

    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return F.when(F.coalesce(extra, F.lit("{}")) == "{}", "{}").otherwise(F.pandas_udf(batch, "string")(extra))


def date_partition(ts: Column) -> Column:
    """The leading YYYY-MM-DD of the source's text, unparsed, or 'unknown'."""
    return F.when(ts.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(ts, 1, 10)).otherwise("unknown")


def file_stem(name: Column) -> Column:
    return F.regexp_replace(F.substring_index(name, "/", -1), r"(?<=.)\.[^.]*$", "")


def fingerprint(runtime: Column, session_id: Column, ts: Column, event_type: Column, text: Column, tool_name: Column, model: Column, extra: Column) -> Column:
    """32 hex digits of the identity of an event; project, machine and token counts do not count."""
    parts = [F.concat(F.coalesce(c, F.lit("")), F.lit("\n")) for c in (runtime, session_id, ts, event_type, text, tool_name, model, extra)]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 32)


def session_hash(runtime: Column, session_id: Column) -> Column:
    return F.sha2(F.concat(runtime, F.lit("\n"), session_id), 256)
