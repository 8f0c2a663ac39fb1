"""Tolerant extraction of one JSON object from model output.

Spark's JSON functions accept trailing text and single quotes, so this uses Python's decoder, in Arrow
batches. The whole text is tried first, then fenced parts, then every opening brace, left to right. Text that
is nested too deeply for the decoder holds no object. Each brace may fail after reading to the end of a
long text, so after PATIENCE failures a scanner takes over, which tells of every brace that it has passed
whether its object closes, and the work stays linear in what is nested.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

FENCE, FENCE_NAMES = "```", ("json", "JSON")
#: Braces that are tried by the decoder before the scanner.
PATIENCE = 32
TOKEN = re.compile(r'[ \t\r\n]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity))')
_decode = json.JSONDecoder().raw_decode


def fenced(text: str) -> Iterator[str]:
    """What stands between fences, without the name of the language."""
    at = text.find(FENCE)
    while at >= 0:
        begin = at + len(FENCE)
        begin += next((len(n) for n in FENCE_NAMES if text.startswith(n, begin)), 0)
        end = text.find(FENCE, begin)
        if end < 0:
            return
        yield text[begin:end].strip()
        at = text.find(FENCE, end + len(FENCE))


def closed_objects(text: str, at: int) -> tuple[int | None, set[int]]:
    """Reads one value from text[at], without recursion: where the first of its objects that closes begins, and all braces seen as objects.

    What a container may hold next is on a stack: "k" a key or the end, "K" a key, ":" a colon, "v" a value, "V" a value or
    the end, "," a comma or the end.
    """
    stack: list[list] = []
    seen: set[int] = set()
    best: int | None = None
    while True:
        found = TOKEN.match(text, at)
        if not found:
            return best, seen
        at, (mark, string, scalar) = found.end(), found.groups()
        state = stack[-1][1] if stack else "v"
        if mark in ("}", "]") and stack and stack[-1][0] == mark and state in (("k", ",") if mark == "}" else ("V", ",")):
            _, _, begin = stack.pop()
            if mark == "}" and (best is None or begin < best):
                best = begin
            if not stack:
                return best, seen
            stack[-1][1] = ","
        elif mark in ("{", "[") and state in ("v", "V"):
            if mark == "{":
                seen.add(at - 1)
            stack.append(["}" if mark == "{" else "]", "k" if mark == "{" else "V", at - 1])
        elif mark == "," and state == ",":
            stack[-1][1] = "K" if stack[-1][0] == "}" else "v"
        elif mark == ":" and state == ":":
            stack[-1][1] = "v"
        elif string and state in ("k", "K"):
            stack[-1][1] = ":"
        elif (string or scalar) and stack and state in ("v", "V"):
            stack[-1][1] = ","
        else:
            return best, seen


def _object_at(text: str, at: int) -> dict | None:
    try:
        value, _ = _decode(text, at)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def find_object(text: str | None) -> dict | None:
    """The first candidate that parses to an object; None if there is none."""
    text = text or ""
    if not text.strip():
        return None
    for candidate in (text.strip(), *fenced(text)):
        try:
            value = json.loads(candidate)
        except (ValueError, RecursionError):
            continue
        if isinstance(value, dict):
            return value
    at, failed, known = text.find("{"), 0, set()
    while at >= 0:
        if failed < PATIENCE:
            if (value := _object_at(text, at)) is not None:
                return value
            failed += 1
        elif at not in known:
            begin, seen = closed_objects(text, at)
            if begin is not None:
                between = min([begin, *(k for k in _braces(text, at, begin) if k not in seen and _object_at(text, k) is not None)])
                return _object_at(text, between)
            known |= seen
        at = text.find("{", at + 1)
    return None


def _braces(text: str, at: int, end: int) -> Iterator[int]:
    at = text.find("{", at + 1)
    while 0 <= at < end:
        yield at
        at = text.find("{", at + 1)


@F.pandas_udf(StringType())
def extract_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The object found, as compact JSON with sorted keys; null if there is none."""
    for batch in texts:
        found = [find_object(t) for t in batch]
        yield pd.Series([None if v is None else json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for v in found], dtype=object)
