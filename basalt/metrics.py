"""Opt-in JSON events about calls: names, times and counts, never values of cells.

Events are made on the driver, around what the caller does there; row counts come
from the caller or from an Observation, so measuring runs no job of its own.
"""

from __future__ import annotations

import inspect
import json
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime
from functools import wraps
from typing import Any

from .errors import EngineError

#: Parameters that are told as they are, and those of which the number is told.
TOLD = ("columns", "order_by", "version", "how", "left_keys", "right_keys", "group_by", "output_column", "column", "name", "max_distinct_keys", "max_bytes", "exact", "allow_numeric_widening", "keep")
COUNTED = {"aggregations": "aggregation_count", "rules": "rule_count"}
#: Parameters that are tables, and what their rows are called.
TABLES = {"df": "rows_in", "left": "rows_in", "actual": "rows_in", "right": "rows_in_right", "small": "rows_in_right", "expected": "rows_in_expected"}

_lock = threading.Lock()
_sink: Callable[[dict], None] | None = None


def _printed(event: dict) -> None:
    print(json.dumps(event), flush=True)


def _appended(path: str) -> Callable[[dict], None]:
    def put(event: dict) -> None:
        with open(path, "a", encoding="utf-8") as out:
            out.write(json.dumps(event) + "\n")

    return put


def enable(sink: str | Callable[[dict], None] = "stdout") -> None:
    """Send events to standard output, a file (lines are added) or a function."""
    global _sink
    _sink = sink if callable(sink) else _printed if sink == "stdout" else _appended(sink)


def disable() -> None:
    global _sink
    _sink = None


def is_enabled() -> bool:
    return _sink is not None


def row_count(obj: Any) -> int | None:
    """num_rows or the length of what has one; never runs a job."""
    n = getattr(obj, "num_rows", None)
    if isinstance(n, int):
        return n
    return len(obj) if hasattr(obj, "__len__") else None


def _told(e: BaseException) -> str:
    """Type and message of this library's own errors, which speak of names and types; of others, whose messages may hold values, the type alone."""
    return f"{type(e).__name__}: {e}" if isinstance(e, EngineError) else type(e).__name__


@contextmanager
def measure(function: str, **fields: Any) -> Iterator[dict]:
    """One event for the block: what the block adds to the yielded dict is part of it. Errors are recorded and raised again."""
    if _sink is None:
        yield {}
        return
    event: dict = {"function": function, "ts": datetime.now(UTC).isoformat(), **fields}
    began = time.perf_counter()
    try:
        yield event
    except BaseException as e:
        event |= {"status": "error", "error": _told(e)}
        raise
    else:
        event.setdefault("status", "ok")
    finally:
        took = time.perf_counter() - began
        event["duration_ms"] = round(took * 1000, 3)
        rows = event.get("rows_in", event.get("rows"))
        event["rows_per_second"] = round(rows / took, 1) if isinstance(rows, int) and took > 0 else None
        event.setdefault("error", None)
        with _lock:
            if _sink is not None:
                _sink(event)


def counted(df):
    """df, and an Observation that has its ``rows`` once an action of the caller's has run over it."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def _fields_of(arguments: dict) -> dict:
    """What an event says of a call's arguments: names and counts; rows where they are known without a job."""
    fields: dict = {}
    for name, value in arguments.items():
        if name in TOLD and (value is None or isinstance(value, (str, int, bool, list, tuple))):
            fields[name] = list(value) if isinstance(value, (list, tuple)) else value
        elif name in COUNTED:
            fields[COUNTED[name]] = row_count(value)
        elif name in TABLES and not isinstance(value, str):
            fields[TABLES[name]] = row_count(value)
    return fields


def instrumented(function: Callable) -> Callable:
    """The function with an event for each call: its parameters, and rows in and out where they are known."""
    bind = inspect.signature(function).bind

    @wraps(function)
    def call(*args, **kwargs):
        if _sink is None:
            return function(*args, **kwargs)
        try:
            bound = bind(*args, **kwargs)
            bound.apply_defaults()
            fields = _fields_of(bound.arguments)
        except TypeError:
            fields = {}
        with measure(function.__name__, **fields) as event:
            out = function(*args, **kwargs)
            event["rows_out"] = row_count(out)
            return out

    return call
