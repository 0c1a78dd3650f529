"""Deeply nested JSON records turned into flat, linked tables in a single pass.

One depth-first visitor per text emits tagged rows: the tag names the table, the row carries its own
path, the path of its parent object and its scalar fields as payload. Rows of all tables leave in one
stream; they are written partitioned by tag, and each table gets its schema when it is read.
A text is handled by one task alone and is never joined back, so nothing is shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys whose objects become rows; the key is the tag.
TAGS = ("body", "names", "comparators")
#: Scalar fields of each table.
TABLE_SCHEMAS = {
    "body": "`_type` string, name string, module string, level string, lineno int, end_lineno int",
    "names": "`_type` string, name string, asname string, lineno int, end_lineno int",
    "comparators": "`_type` string, value string, id string, `_const_preview` string, lineno int, end_lineno int",
}

_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_SPACE = re.compile(r"[ \t\n\r]*")
_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
_WORDS = {"true": True, "false": False, "null": None}


def _refuse(word: str):
    raise ValueError(f"not JSON: {word}")


def _parse_deep(text: str):
    """JSON parser without recursion, for texts nested deeper than the C parser allows."""
    pos, n = _SPACE.match(text).end(), len(text)
    root: list = []
    stack: list = [(root, None)]  # (container, pending key of an object)
    state = "value"
    while True:
        pos = _SPACE.match(text, pos).end()
        if state == "end":
            top, key = stack[-1]
            if len(stack) == 1:
                if pos != n:
                    raise ValueError("text after the value")
                return root[0]
            c = text[pos : pos + 1]
            if c == ",":
                pos, state = pos + 1, "key" if isinstance(top, dict) else "value"
            elif c == ("}" if isinstance(top, dict) else "]") and c:
                pos += 1
                stack.pop()
            else:
                raise ValueError("expected , or a closing bracket")
            continue
        c = text[pos : pos + 1]
        if state in ("key", "key or end"):
            if state == "key or end" and c == "}":
                stack.pop()
                pos, state = pos + 1, "end"
                continue
            m = _STRING.match(text, pos)
            if not m:
                raise ValueError("expected a key")
            after = _SPACE.match(text, m.end()).end()
            if text[after : after + 1] != ":":
                raise ValueError("expected :")
            stack[-1] = (stack[-1][0], json.loads(m[0]))
            pos, state = after + 1, "value"
            continue
        if state == "value or end" and c == "]":
            stack.pop()
            pos, state = pos + 1, "end"
            continue
        if c == "{":
            value, pos, state = {}, pos + 1, "key or end"
        elif c == "[":
            value, pos, state = [], pos + 1, "value or end"
        elif c == '"':
            m = _STRING.match(text, pos)
            if not m:
                raise ValueError("damaged string")
            value, pos, state = json.loads(m[0]), m.end(), "end"
        else:
            word = next((w for w in _WORDS if text.startswith(w, pos)), None)
            if word:
                value, pos, state = _WORDS[word], pos + len(word), "end"
            elif m := _NUMBER.match(text, pos):
                value, pos, state = json.loads(m[0]), m.end(), "end"
            else:
                raise ValueError("expected a value")
        top, key = stack[-1]
        if isinstance(top, dict):
            top[key] = value
        else:
            top.append(value)
        if isinstance(value, dict | list) and state != "end":
            stack.append((value, None))


def parse_tree(text: str | None):
    """The JSON value of a text, or None where it isn't complete JSON.

    A leading byte order mark is ignored; a JSON string that itself holds JSON is opened, any number of times.
    """
    while text is not None:
        text = text.removeprefix("﻿")
        try:
            try:
                value = json.loads(text, parse_constant=_refuse)
            except RecursionError:
                value = _parse_deep(text)
        except ValueError:
            return None
        if not isinstance(value, str):
            return value
        text = value
    return None


def visit(tree, tags: tuple[str, ...] = TAGS, payload: bool = True) -> Iterator[tuple[str, str, str, str | None]]:
    """(tag, path, parent path, payload) of each object found directly, or in a list, under a tagged key.

    Depth first in text order, with a stack of its own, so depth is unbounded. Lists within lists and
    scalars give no row but are searched. The payload is the object's scalar fields as JSON, so the
    output grows with the text and not with its depth.
    """
    wanted = frozenset(tags)
    stack: list = [(tree, "$")] if isinstance(tree, dict | list) else []
    while stack:
        node, path = stack.pop()
        if type(node) is tuple:
            yield node
            continue
        below: list = []
        if isinstance(node, dict):
            for key, value in node.items():
                if isinstance(value, dict):
                    at = f"{path}.{key}"
                    if key in wanted:
                        below.append(((key, at, path, _scalars(value) if payload else None), ""))
                    below.append((value, at))
                elif isinstance(value, list) and value:
                    at = f"{path}.{key}"
                    if key in wanted:
                        for i, item in enumerate(value):
                            if isinstance(item, dict):
                                below.append(((key, f"{at}[{i}]", path, _scalars(item) if payload else None), ""))
                                below.append((item, f"{at}[{i}]"))
                            elif isinstance(item, list):
                                below.append((item, f"{at}[{i}]"))
                    else:
                        below.append((value, at))
        else:
            below = [(item, f"{path}[{i}]") for i, item in enumerate(node) if isinstance(item, dict | list)]
        stack.extend(reversed(below))


def _scalars(node: dict) -> str:
    return json.dumps({k: v for k, v in node.items() if not isinstance(v, dict | list)}, ensure_ascii=False)


def flatten_records(df: DataFrame, id_col: str, text_col: str, tags: tuple[str, ...] = TAGS, payload: bool = True) -> DataFrame:
    """Tagged rows (record_id, tag, path, parent_path, payload) of all texts of ``df``.

    Null, empty and incomplete texts and texts of a scalar give no rows. Repeated ids are visited one by
    one. Only the two named columns are read, so other columns may have any names.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["record_id", "tag", "path", "parent_path", "payload"]
        for batch in batches:
            rows: list[tuple] = []
            for rid, text in zip(batch["record_id"], batch["body_text"], strict=True):
                tree = parse_tree(text)
                rows.extend((rid, *row) for row in visit(tree, tags, payload))
                if len(rows) >= 50_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    narrow = df.select(F.col(id_col).cast("long").alias("record_id"), F.col(text_col).alias("body_text")).where("body_text is not null and body_text <> ''")
    return narrow.mapInPandas(emit, "record_id long, tag string, path string, parent_path string, payload string")


def table_of(tagged: DataFrame, tag: str) -> DataFrame:
    """One flat table of the tagged rows, with its declared scalar fields; a field of another type is null."""
    fields = F.from_json("payload", TABLE_SCHEMAS[tag])
    return tagged.where(F.col("tag") == tag).select("record_id", "path", "parent_path", fields.alias("f")).select("record_id", "path", "parent_path", "f.*")


def write_tables(tagged: DataFrame, folder: str) -> None:
    """Write all tables in one pass, partitioned by tag."""
    tagged.write.mode("overwrite").partitionBy("tag").parquet(folder)
