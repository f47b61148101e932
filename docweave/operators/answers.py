"""One answer checked in Python, by the rules that ``check_answers`` has for columns of them."""

from __future__ import annotations

import functools
import json
import re

from ..functions.replies import (
    INVALID_ARGUMENTS,
    NO_FUNCTION_CALL,
    OK,
    SKIPPED,
    UNEXPECTED_FUNCTION,
)
from ..schema import CLASS, FUNCTION_CALL_NAMES, SKIP_CALL_NAME
from .lookups import UNSUPPORTED_TYPE

_TYPED, _NAMED = ("name", "description", "assumed_type"), ("name", "description")
_LISTS = {"parameters": _TYPED, "return_values": _TYPED, "exceptions": _NAMED}


def _distinct_fields(pairs: list[tuple]) -> dict:
    fields = dict(pairs)
    if len(fields) < len(pairs):
        raise ValueError("a field comes twice")
    return fields


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


#: Nesting and digits of a number that Spark's JSON functions read at most.
DEEPEST, LONGEST_NUMBER = 999, 1000
_QUOTED = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)
_LONG_NUMBER = re.compile(rf"\d[\d.]{{{LONGEST_NUMBER},}}")


def _is_too_large(text: str) -> bool:
    if text.count("[") + text.count("{") <= DEEPEST and len(text) <= LONGEST_NUMBER:
        return False
    bare = _QUOTED.sub("", text)
    depth = deepest = 0
    for mark in re.findall(r"[\[\]{}]", bare):
        depth += 1 if mark in "[{" else -1
        deepest = max(deepest, depth)
    return deepest > DEEPEST or _LONG_NUMBER.search(bare) is not None


@functools.cache
def _decoder() -> json.JSONDecoder:  # made where it is used: it cannot travel to the executors
    return json.JSONDecoder(object_pairs_hook=_distinct_fields, parse_constant=_no_constant)


def _texts(value: dict, fields: tuple[str, ...]) -> dict | None:
    filled = {}
    for field in fields:
        text = value.get(field, "")
        if not isinstance(text, str):
            return None
        # Half a surrogate pair is no character; Spark's JSON functions read it as this mark too.
        filled[field] = text if text.isascii() else text.encode("utf-8", "replace").decode()
    return filled


def read_arguments(text: str | None, definition_type: str) -> dict | None:
    """The data with defaults; None if a field has another type, or this is not one JSON object."""
    try:
        value = _decoder().decode(text or "")
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, dict) or _is_too_large(text) or (data := _texts(value, ("description",))) is None:
        return None
    for name, fields in _LISTS.items():
        items = [] if definition_type == CLASS else value.get(name, [])
        if not isinstance(items, list):
            return None
        data[name] = [_texts(item, fields) if isinstance(item, dict) else None for item in items]
        if None in data[name]:
            return None
    return data


def reply_arguments(text: str | None, call_name: str) -> tuple[str, str | None]:
    """Status of a whole chat reply, and the arguments of its call."""
    try:
        value, _ = _decoder().raw_decode((text or "").lstrip(" \t\r\n"))
        call = value["choices"][0]["message"]["function_call"]
    except (ValueError, RecursionError, LookupError, TypeError):
        return NO_FUNCTION_CALL, None
    name = call.get("name") if isinstance(call, dict) else None
    if name == SKIP_CALL_NAME:
        return SKIPPED, None
    if name != call_name:
        return UNEXPECTED_FUNCTION, None
    arguments = call.get("arguments")
    return (OK, arguments) if isinstance(arguments, str) else (INVALID_ARGUMENTS, None)


def checked_answer(answer: dict) -> dict:
    """``data``, ``status`` and ``error`` of what ``call_generator`` gives."""
    kind, raw, data = answer["definition_type"], answer["raw"], None
    status = answer["status"]
    call_name = dict(FUNCTION_CALL_NAMES).get(kind)
    if status == OK and call_name is None:
        status = UNSUPPORTED_TYPE
    if status == OK and answer["is_reply"]:
        status, raw = reply_arguments(raw, call_name)
    if status == OK and (data := read_arguments(raw, kind)) is None:
        status = INVALID_ARGUMENTS
    error = None if status == OK else next((e for e in (answer["error"], answer["raw"]) if e is not None), None)
    return {"data": data, "status": status, "error": error}
