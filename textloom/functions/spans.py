"""Where injected strings stand in a normalised text, also when a YAML dump has escaped them.

Escapes are decoded and texts are normalised with maps: for each character of the result, the place it came from.
Built-in functions have no such maps; the work is done an Arrow batch at a time, row by row within it.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Escapes of YAML double-quoted scalars (fixed values of the YAML specification).
ESCAPES = {
    "n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\", "/": "/", " ": " ", "0": "\0", "a": "\a",
    "b": "\b", "e": "\x1b", "f": "\f", "v": "\v", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029",
}
_ESCAPE = re.compile(
    r"(?P<quote>'')|\\(?:(?P<fold>(?:\r\n?|\n)[ \t]*)|x(?P<x>[0-9a-fA-F]{2})|u(?P<u>[0-9a-fA-F]{4})|U(?P<U>[0-9a-fA-F]{8})|(?P<short>[" + re.escape("".join(ESCAPES)) + "]))"
)


def _decoded(m: re.Match) -> str | None:
    kind, value = m.lastgroup, m.group(m.lastgroup)
    if kind == "quote":
        return "'"
    if kind == "fold":
        return ""
    if kind == "short":
        return ESCAPES[value]
    code = int(value, 16)
    return chr(code) if code <= 0x10FFFF else None


def decode_escapes(text: str) -> tuple[str, list[int]]:
    """The text without YAML escapes, doubled quotes and folds, and each character's place in ``text``."""
    out, at, done = [], [], 0
    for m in _ESCAPE.finditer(text):
        new = _decoded(m)
        if new is None:  # no such character: it stays as it is written
            continue
        out += [text[done : m.start()], new]
        at += [*range(done, m.start()), *[m.start()] * len(new)]
        done = m.end()
    return "".join([*out, text[done:]]), [*at, *range(done, len(text))]


def _pieces(text: str) -> list[tuple[int, int]]:
    """Cuts of ``text`` whose NFKC forms, side by side, are the NFKC form of the whole.

    A character opens a piece if normalising it together with the piece before it gives the two normal forms.
    """
    cuts = [0]
    for i in range(1, len(text)):
        if text[i].isascii():
            cuts.append(i)
        elif not unicodedata.combining(text[i]):
            before = text[cuts[-1] : i]
            if unicodedata.normalize("NFKC", before + text[i]) == unicodedata.normalize("NFKC", before) + unicodedata.normalize("NFKC", text[i]):
                cuts.append(i)
    return list(zip(cuts, [*cuts[1:], len(text)], strict=True))


def normal_with_map(text: str) -> tuple[str, list[int]]:
    """NFKC with white space collapsed and none at the ends, and each character's place in ``text``."""
    whole, at = unicodedata.normalize("NFKC", text), list(range(len(text)))
    if whole != text:
        parts = [(a, b, unicodedata.normalize("NFKC", text[a:b])) for a, b in _pieces(text)]
        if "".join(p for *_, p in parts) != whole:
            parts = [(0, len(text), whole)]
        at = [min(a + k, b - 1) for a, b, p in parts for k in range(len(p))]
    words = list(re.finditer(r"\S+", whole))
    places: list[int] = []
    for k, m in enumerate(words):
        if k:
            places.append(at[words[k - 1].end()])
        places += at[m.start() : m.end()]
    return " ".join(m.group() for m in words), places


def normal(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).split())


def _all(text: str, needle: str) -> list[tuple[int, int]]:
    return [(m.start(), m.start() + len(needle)) for m in re.finditer(f"(?={re.escape(needle)})", text)]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            a, b = out[-1][0], max(b, out.pop()[1])
        out.append((a, b))
    return out


def find_spans(text: str | None, needles: list[str] | None, escaped: bool = True) -> tuple[list[tuple[int, int]], str | None]:
    """Spans in the normalised text, and ``exact`` or ``yaml_escaped`` if any was found only after decoding.

    Every needle is looked for as it is; those that aren't there are looked for in the decoded text, and their places
    are carried back to the normalised one.
    """
    shown = normal(text or "")
    wanted = [w for w in (normal(n or "") for n in needles or []) if w]
    exact = {w: _all(shown, w) for w in wanted} if shown else {}
    hidden: list[tuple[int, int]] = []
    rest = [w for w, found in exact.items() if not found]
    if rest and escaped and (decoded := decode_escapes(text)) and decoded[0] != text:
        inner, inner_at = normal_with_map(decoded[0])
        outer, outer_at = normal_with_map(text)
        if outer == shown and outer_at == sorted(outer_at):
            for w in rest:
                for a, b in _all(inner, w):
                    start = bisect_left(outer_at, decoded[1][inner_at[a]])
                    end = bisect_right(outer_at, decoded[1][inner_at[b - 1]])
                    if start < end:
                        hidden.append((start, end))
    spans = _merged([s for found in exact.values() for s in found] + hidden)
    return spans, ("yaml_escaped" if hidden else "exact") if spans else None


def injection_spans(text: Column, needles: Column, escaped: bool = True) -> Column:
    """struct(spans, mode) of the strings ``needles`` in the normalised text; null and empty texts and needles have none."""

    def run(texts: pd.Series, wanted: pd.Series) -> pd.DataFrame:
        got = [find_spans(t, None if w is None else list(w), escaped) for t, w in zip(texts, wanted, strict=True)]
        return pd.DataFrame({"spans": [[{"start": a, "end": b} for a, b in s] for s, _ in got], "mode": [m for _, m in got]})

    return F.pandas_udf(run, "struct<spans: array<struct<start: int, end: int>>, mode: string>")(text, needles)
