"""Reading of model responses that should be JSON arrays: fences, quotes, commas, cut-off ends."""

from __future__ import annotations

import json
import re

_FENCE = re.compile(r"^```[a-z]*[ \t]*$", re.M)
_TRAILING = re.compile(r",\s*([}\]])")


def complete_objects(text: str) -> tuple[list[str], str]:
    """Top-level brace groups of a text, with strings and escapes respected, and the unfinished one at its end, if there is one."""
    found, depth, begin, quoted, escaped = [], 0, 0, False, False
    for at, c in enumerate(text):
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = depth > 0
        elif c == "{":
            if not depth:
                begin = at
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                found.append(text[begin : at + 1])
    return found, text[begin:] if depth else ""


def completed(cut: str) -> dict | None:
    """An object whose end is missing, closed in the first way that can be read: its string, its value, its brackets."""
    closers, quoted, escaped = [], False, False
    for c in cut:
        if escaped:
            escaped = False
        elif quoted and c == "\\":
            escaped = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{[":
            closers.append("}" if c == "{" else "]")
        elif not quoted and c in "}]" and closers:
            closers.pop()
    end = "".join(reversed(closers))
    for begun in ((cut + '"', cut + '": ""', cut + '": null') if quoted else (cut.rstrip().rstrip(","), cut + " null", cut + ": null")):
        value = _loads(begun + end)
        if isinstance(value, dict):
            return value
    return None


def _loads(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def repair(text: str | None) -> list:
    """The array a response holds: as it is; else with trailing commas or the missing bracket mended, else its complete objects and the
    one that its end cuts off, completed where that can be."""
    bare = _FENCE.sub("", text or "").strip()
    for candidate in (bare, bare.replace("'", '"')):
        for mended in (candidate, _TRAILING.sub(r"\1", candidate), _TRAILING.sub(r"\1", candidate.rstrip().rstrip(",") + "]")):
            value = _loads(mended)
            if isinstance(value, list):
                return value
            if isinstance(value, dict):
                return [value]
    for candidate in (bare, bare.replace("'", '"')):
        whole, cut = complete_objects(candidate)
        objects = [x for x in (*(_loads(_TRAILING.sub(r"\1", o)) for o in whole), completed(cut) if cut else None) if x is not None]
        if objects:
            return objects
    return []


def extract_queries(text: str | None) -> list[str]:
    """Distinct queries of a response as JSON with sorted keys, the first of equals; a string becomes {"description": ...}."""
    seen: dict[str, None] = {}
    for item in repair(text):
        value = {"description": item} if isinstance(item, str) else item
        if isinstance(value, dict):
            seen.setdefault(json.dumps(value, sort_keys=True, ensure_ascii=False))
    return list(seen)
