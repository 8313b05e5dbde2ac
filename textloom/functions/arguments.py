"""Arguments of tool calls: normal values, flattening, and the match of a call with reference calls."""

from __future__ import annotations

import ast
import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import normal

DEPTH = 32  # nesting that is flattened
_IBAN = re.compile(r"[a-z]{2}\d{2}[a-z0-9]{10,30}")


def normal_value(value: Any) -> str:
    """NFKC, lower case, without scheme, leading www., closing slashes, and the spaces of an account number."""
    text = re.sub(r"^[a-z][a-z0-9+.-]*://", "", normal(str(value)).lower())
    text = text.removeprefix("www.").rstrip("/")
    bare = text.replace(" ", "")
    return bare if bare != text and _IBAN.fullmatch(bare) else text


def listed(text: str) -> list[Any] | None:
    """The elements of a list that is written as text, else None."""
    text = text.strip()
    if not re.fullmatch(r"(?s)[\[(].*[\])]", text):
        return None
    for read in (ast.literal_eval, json.loads):
        try:
            got = read(text)
        except (ValueError, SyntaxError, TypeError, RecursionError, MemoryError):
            continue
        return list(got) if isinstance(got, list | tuple | set) else None
    return None


def items(value: Any) -> list[str]:
    """Normal values of everything that an argument holds, in its order; a map counts as its JSON text too."""
    out: list[str] = []
    todo = [(value, 0)]
    while todo:
        x, depth = todo.pop()
        if depth <= DEPTH and isinstance(x, str) and (got := listed(x)) is not None:
            x = got
        inner: list[Any] = []
        if depth <= DEPTH and isinstance(x, list | tuple | set):
            inner = list(x)
        elif x is not None:
            out.append(normal_value(json.dumps(x, ensure_ascii=False, sort_keys=True) if isinstance(x, dict) and depth <= DEPTH else x))
            inner = list(x.values()) if isinstance(x, dict) and depth <= DEPTH else []
        todo += [(y, depth + 1) for y in reversed(inner)]
    return out


def _of_key(args: dict[str, Any], key: str) -> list[str]:
    """``a|b|c``: the items of all of these arguments."""
    return [x for name in key.split("|") if name.strip() in args for x in items(args[name.strip()])]


def _fits(args: dict[str, Any], call: dict[str, Any]) -> bool:
    for key, wanted in (call.get("key") or {}).items():
        held = _of_key(args, key)
        for w in wanted if isinstance(wanted, list | tuple | set) else [wanted]:
            if not any(normal_value(w) and normal_value(w) in x for x in held):
                return False
        if not held:
            return False
    return all((held := _of_key(args, key)) and normal_value(part) in " ".join(held) for key, part in (call.get("contains") or {}).items())


def match(tool: str | None, args: dict[str, Any] | None, calls: list[dict[str, Any]]) -> str | None:
    """``full`` if name and arguments fit one of the reference calls, ``name_only`` if only a name does."""
    named = [c for c in calls if normal_value(tool or "") in {normal_value(n) for n in [c.get("function"), *(c.get("alt_functions") or [])] if n is not None}]
    if any(_fits(args or {}, c) for c in named):
        return "full"
    return "name_only" if named else None


def argument_items(args: Column) -> Column:
    """Of a JSON text: the flattened normal values; null and malformed texts have none."""

    def of(text: str | None) -> list[str]:
        try:
            return items(json.loads(text)) if text is not None else []
        except ValueError:
            return []

    return F.pandas_udf(lambda s: s.map(of), "array<string>")(args)


def call_match(tool: Column, args: Column, calls: Column) -> Column:
    """``match`` of a call whose arguments are a JSON map, with reference calls as a JSON list."""

    def run(tools: pd.Series, given: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([match(t, json.loads(a) if a else None, json.loads(c) if c else []) for t, a, c in zip(tools, given, wanted, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(tool, args, calls)
