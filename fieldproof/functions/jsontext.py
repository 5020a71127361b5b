"""Reading of JSON texts whose shape isn't known beforehand."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, functions as F


class _Unreadable:
    """The one mark of a text that can't be read; stays the same object when sent to workers."""

    def __reduce__(self) -> str:
        return "UNREADABLE"

    def __repr__(self) -> str:
        return "UNREADABLE"


UNREADABLE = _Unreadable()


def read_json(text: str | None) -> Any:
    """The value of a JSON text, unwrapping texts that hold a JSON text; UNREADABLE if there is none.

    Null and cut-off texts, and strings that hold no JSON text, are UNREADABLE. Of members with the
    same name the last counts. Nesting may be of any depth.
    """
    value: Any = text
    while isinstance(value, str):
        try:
            value = json.loads(value)
        except RecursionError:
            value = _read_deep(value)
        except ValueError:
            return UNREADABLE
    return UNREADABLE if text is None else value


_BLANKS = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null|-?Infinity|NaN")


def _read_deep(text: str) -> Any:
    """What json.loads gives, for texts that nest too deeply for it: open containers are kept in a list, not on the call stack."""
    top: list = []
    open_: list[tuple[Any, Any]] = [(top, None)]  # container, name of the member that is being read
    at, wants = 0, "value"
    while True:
        at = _BLANKS.match(text, at).end()
        here, name = open_[-1]
        mark = text[at : at + 1]
        if here is top and top and wants == "next":
            return UNREADABLE if mark else top[0]
        if wants == "next" and mark == ",":
            at, wants = at + 1, "name" if isinstance(here, dict) else "value"
        elif here is not top and mark == ("}" if isinstance(here, dict) else "]") and wants in ("next", "first"):
            open_.pop()
            at, wants = at + 1, "next"
        elif isinstance(here, dict) and mark == '"' and wants in ("name", "first"):
            try:
                name, at = json.decoder.scanstring(text, at + 1)
            except ValueError:
                return UNREADABLE
            at = _BLANKS.match(text, at).end()
            if text[at : at + 1] != ":":
                return UNREADABLE
            open_[-1] = (here, name)
            at, wants = at + 1, "value"
        elif wants == "value" or wants == "first" and isinstance(here, list):
            if mark and mark in "{[":
                value: Any = {} if mark == "{" else []
                at, wants_then = at + 1, "first"
            elif mark == '"':
                try:
                    value, at = json.decoder.scanstring(text, at + 1)
                except ValueError:
                    return UNREADABLE
                wants_then = "next"
            elif m := _SCALAR.match(text, at):
                value, at, wants_then = json.loads(m.group()), m.end(), "next"
            else:
                return UNREADABLE
            if isinstance(here, dict):
                here[name] = value
            else:
                here.append(value)
            if wants_then == "first":
                open_.append((value, None))
            wants = wants_then
        else:
            return UNREADABLE


def objects(value: Any, path: str) -> Iterator[tuple[str, str, dict]]:
    """(path, path of the nearest enclosing object or '', object) of each object, depth first."""
    stack: list[tuple[Any, str, str]] = [(value, path, "")]
    while stack:
        node, here, parent = stack.pop()
        if isinstance(node, dict):
            yield here, parent, node
            stack.extend((v, f"{here}.{k}", here) for k, v in reversed(node.items()) if isinstance(v, (dict, list)))
        elif isinstance(node, list):
            stack.extend((node[i], f"{here}[{i}]", parent) for i in range(len(node) - 1, -1, -1) if isinstance(node[i], (dict, list)))


def leaves(value: Any, path: str = "", indexed: bool = True) -> Iterator[tuple[str, Any]]:
    """(path, scalar) of each scalar, in no promised order."""
    stack: list[tuple[Any, str]] = [(value, path)]
    while stack:
        node, here = stack.pop()
        if isinstance(node, dict):
            stack.extend((v, f"{here}.{k}" if here else k) for k, v in node.items())
        elif isinstance(node, list):
            stack.extend((v, f"{here}[{i}]" if indexed else f"{here}[]") for i, v in enumerate(node))
        else:
            yield here, node


def outer_object(text: Column, layers: int = 4) -> Column:
    """The JSON text of the outermost object, unwrapped from JSON texts in JSON texts (up to `layers`); null if there is none."""
    for _ in range(layers):
        text = F.when(F.ltrim(text).startswith('"'), F.get_json_object(text, "$")).otherwise(text)
    return F.when(F.ltrim(text).startswith("{") & F.try_parse_json(text).isNotNull(), text)


def text_at(text: Column, path: Column) -> Column:
    """What a JSON text has at a path like a.b[0].c, as text; names may hold any characters but dots, brackets and quotes."""
    steps = F.replace(F.regexp_replace(path, r"([^.\[\]]+)(?=[.\[]|$)", "['$1']"), F.lit("]."), F.lit("]"))
    return F.call_function("get_json_object", text, F.concat(F.lit("$"), steps))
