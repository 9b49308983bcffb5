"""Run user-supplied handlers over a corpus of files: routing, dispatch, per-file outcomes.

Handlers are plain Python functions `handler(name, content, target) -> [(name, bytes, note, warning), …]` or a `Failure`
registered by engine id. Spark partitions the files; a partition streams through its handlers batch by
batch. A failing file yields an error row and never stops the others.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ordered
from . import catalog

Handler = Callable[[str, bytes, str], "list[tuple] | Failure"]
RESULT = ("file_id long, result_no int, name string, content binary, size long, status string, error_kind string, error string, "
          "note string, warning string")


class Failure(NamedTuple):
    """What a handler returns instead of files: `kind` is convert, password_needed or password_wrong."""
    kind: str
    message: str


class Registry:
    """Named tasks: name -> (what it needs, function). Sent to the workers as one object."""

    def __init__(self):
        self._tasks: dict[str, tuple[tuple[str, ...], Handler]] = {}

    def register(self, name: str, fn: Handler, needs: tuple[str, ...] = ()) -> Registry:
        self._tasks[name] = (tuple(needs), fn)
        return self

    def names(self) -> list[str]:
        return list(self._tasks)

    def needs(self, name: str) -> tuple[str, ...]:
        return self._tasks[name][0]

    def get(self, name: str) -> Handler | None:
        return self._tasks[name][1] if name in self._tasks else None


def register_task(registry: Registry, name: str, fn: Handler, needs: tuple[str, ...] = ()) -> Registry:
    return registry.register(name, fn, needs)


def _load(registry: Registry, name: str) -> Handler | None:
    """The handler of a task, its modules imported first so that a missing one is a load failure."""
    fn = registry.get(name)
    if fn is not None:
        for module in registry.needs(name):
            __import__(module)
    return fn


def _run_file(registry: Registry, engine: str | None, fid: int, name: str, content: bytes, target: str):
    try:
        fn = _load(registry, engine) if engine else None
    except ImportError as e:
        return [(fid, 0, name, None, None, "error", "load", str(e), None, None)]
    try:
        made = fn(name, content, target) if fn else Failure("convert", f"{name}: no handler for this format")
        if isinstance(made, Failure):
            return [(fid, 0, name, None, None, "error", made.kind, made.message, None, None)]
        return [(fid, i, r[0], r[1], len(r[1]), "ok", None, None, r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None)
                for i, r in enumerate(made)]
    except Exception as e:  # whatever a codec throws belongs to its file only
        return [(fid, 0, name, None, None, "error", "unknown", f"{type(e).__name__}: {e}", None, None)]


def convert_corpus(files: DataFrame, registry: Registry, target: str, merge: bool = False) -> DataFrame:
    """Results of converting `files` (file_id, name, content) to `target`, one row per produced file or failure.

    `merge` (many files, one output) adds `part_no`, the place of each part in its batch's output; the parts
    stay rows so that a large batch is never assembled in one place.
    """
    routed = catalog.file_category(files).withColumn("_ok", F.array_contains(catalog.targets(catalog.ext_of("name")), target) | F.lit(merge))
    cols = routed.select("file_id", "name", "content", F.when(F.col("_ok"), F.col("engine")).alias("engine"))
    names = [f.split()[0] for f in RESULT.split(", ")]

    def work(batches):
        for pdf in batches:
            rows = [r for e, i, n, c in zip(pdf["engine"], pdf["file_id"], pdf["name"], pdf["content"]) for r in _run_file(registry, e, i, n, c, target)]
            yield pd.DataFrame(rows, columns=names)

    out = cols.mapInPandas(work, RESULT)
    if not merge:
        return out
    placed = out.filter("status = 'ok'").join(files.select("file_id", "batch", "pos"), "file_id")
    return ordered.row_number(placed, ["batch"], "pos", "part_no", ties=["result_no"])


# --- handlers that come with the package ---------------------------------------------------------------

def text_handler(name: str, content: bytes, target: str) -> list[tuple] | Failure:
    """Plain text of a text-like file as UTF-8."""
    if target != "txt":
        return Failure("convert", f"{name}: only txt is made here")
    text = bytes(content).decode("utf-8", errors="replace")
    stem = name.rsplit(".", 1)[0] if "." in name else name
    return [(f"{stem}.txt", text.encode("utf-8"), None, None)]


def tables_of_udtf():
    """`tables_of(doc_id, json)` for SQL users: one document's tables as JSON -> rows (page, table_no, row_no, cells)."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="page int, table_no int, row_no int, cells array<string>", useArrow=False)
    class TablesOf:
        def eval(self, tables: str):
            import json
            for n, t in enumerate(json.loads(tables or "[]")):
                for r, cells in enumerate(t["rows"]):
                    yield t.get("page"), n, r, cells
    return TablesOf


def tables_of(docs: DataFrame, key: str = "doc_id", json_col: str = "tables") -> DataFrame:
    """The same, JVM-side: explode the JSON of each document."""
    schema = "array<struct<page:int,rows:array<array<string>>,text:boolean>>"
    t = docs.select(key, F.posexplode(F.from_json(json_col, schema)).alias("table_no", "t"))
    return t.select(key, "t.page", "table_no", F.posexplode("t.rows").alias("row_no", "cells"))
