"""JSON records against typed columns: which values fit, what they are equal to, and how a misfit can be mended.

Plain Python over Arrow batches: the JVM's variants take ten times as long for a record with many fields."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from decimal import Decimal, InvalidOperation
from typing import Any

import pyarrow as pa

# Bits of the JSON types in a type set; null has no bit.
TYPE_BITS = {"number": 1, "string": 2, "boolean": 4, "array": 8, "object": 16}
_BIT = {type(None): 0, int: 1, float: 1, str: 2, bool: 4, list: 8, dict: 16}
_NUMBER = re.compile(r"\s*-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\s*")
_PERCENT = re.compile(r"\s*(-?[0-9]+(?:\.[0-9]+)?)\s*%\s*")
_MISFIT = object()


def _no_constant(name: str) -> float:
    raise ValueError(name)


def _paired(text: str) -> str:
    """The text with lone surrogates replaced."""
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def record_of(payload: str) -> dict[str, Any] | None:
    """The fields of a JSON object, the last of a name; None for anything else, or with numbers beyond a double."""
    try:
        out = json.loads(payload, parse_constant=_no_constant)
        if not isinstance(out, dict):
            return None
        if "\\ud" in payload or "\\uD" in payload:
            out = json.loads(_paired(text_of(out)))
        if any(type(v) is float and not math.isfinite(v) for v in out.values()):
            return None
        return out
    except (ValueError, RecursionError):
        return None


def text_of(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def bit_of(value: Any) -> int:
    return _BIT[type(value)]


def _double(v: Any) -> Any:
    if type(v) is float:
        return v
    if type(v) is int and abs(v) <= 1 << 1000 and int(float(v)) == v:
        return float(v)
    return _MISFIT


def _bigint(v: Any) -> Any:
    if type(v) is float and v.is_integer():
        v = int(v)
    return v if type(v) is int and -(1 << 63) <= v < 1 << 63 else _MISFIT


def fits(kind: str) -> Callable[[Any], Any]:
    """A function that gives a JSON value as a value of the column type, _MISFIT where that would change it."""
    if kind == "double":
        return _double
    if kind == "bigint":
        return _bigint
    if kind in ("string", "boolean"):
        own = str if kind == "string" else bool
        return lambda v: v if type(v) is own else _MISFIT
    inner = fits(kind[kind.index("<") + 1 : -1].split(",", 1)[-1].strip())
    if kind.startswith("array<"):

        def array(v: Any) -> Any:
            out = [x if x is None else inner(x) for x in v] if type(v) is list else [_MISFIT]
            return _MISFIT if any(x is _MISFIT for x in out) else out

        return array
    if kind.startswith("map<string,"):

        def mapping(v: Any) -> Any:
            out = {k: x if x is None else inner(x) for k, x in v.items()} if type(v) is dict else {"": _MISFIT}
            return _MISFIT if any(x is _MISFIT for x in out.values()) else out

        return mapping
    raise ValueError(f"no rule for columns of type {kind}")


def arrow_of(kind: str) -> pa.DataType:
    plain = {"double": pa.float64(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    if kind in plain:
        return plain[kind]
    inner = arrow_of(kind[kind.index("<") + 1 : -1].split(",", 1)[-1].strip())
    return pa.list_(inner) if kind.startswith("array") else pa.map_(pa.string(), inner)


def enforce(record: dict[str, Any], schema: dict[str, Callable[[Any], Any]]) -> tuple[dict[str, Any], dict[str, Any]]:
    """(values that fit their column, all other fields but nulls of columns)."""
    held, rest = {}, {}
    for k, v in record.items():
        if k in schema:
            if v is not None:
                x = schema[k](v)
                if x is _MISFIT:
                    rest[k] = v
                else:
                    held[k] = x
        else:
            rest[k] = v
    return held, rest


def canonical(v: Any) -> str | None:
    """A string equal for equal values; a number written as a string equals the number; None for null."""
    bit = _BIT[type(v)]
    if bit == 0:
        return None
    if bit == 1 or bit == 2 and _NUMBER.fullmatch(v):
        try:
            return f"n{float(v) + 0.0!r}"
        except OverflowError:
            return f"n{v}"
    if bit == 2:
        return f"2:{v}"
    return f"{bit}:{json.dumps(v, sort_keys=True)}"


def mend(v: Any, kind: str, fit: Callable[[Any], Any]) -> Any:
    """A misfit as a value of the column type: itself, the only value of an array or the ``value`` of an object, numbers
    also where written as strings or percents; None if it gives none."""
    x = fit(v)
    if x is not _MISFIT:
        return x
    if type(v) is list and len(v) == 1:
        v = v[0]
    elif type(v) is dict and v.get("value") is not None:
        v = v["value"]
    x = _MISFIT if v is None else fit(v)
    if x is not _MISFIT:
        return x
    if kind in ("double", "bigint") and type(v) is str:
        if _NUMBER.fullmatch(v):
            number = float(v)
        elif (p := _PERCENT.fullmatch(v)) is not None:
            try:
                number = float(Decimal(p[1]) / 100)
            except InvalidOperation:
                return None
        else:
            return None
        x = fit(number) if math.isfinite(number) else _MISFIT
    elif kind == "boolean" and type(v) is str and v.strip().lower() in ("true", "false"):
        x = v.strip().lower() == "true"
    elif kind == "string" and type(v) in (int, float, bool):
        x = text_of(v)
    return None if x is _MISFIT else x
