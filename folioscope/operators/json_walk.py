"""Walks over whole JSON texts, in Arrow batches: one scan whatever the depth.

A text is JSON as the VARIANT type takes it: strict, without repeated keys in an object, at most
``DEEPEST`` levels deep. Everything else is malformed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How a profile names a text that isn't JSON; its path is empty.
MALFORMED = "malformed"
DEEPEST = 1000
#: Counts that a task holds before it passes them on; so keys that are data can't fill its memory.
MOST_COUNTS = 100_000
#: Whole numbers of more digits are decimals of no exact type.
_LONGEST_INTEGER = 10**38

_TYPES = {type(None): "null", bool: "boolean", int: "integer", float: "number", str: "string", dict: "object", list: "array"}
_COUNTS = pa.schema([("column", pa.string()), ("path", pa.string()), ("type", pa.string()), ("n", pa.int64())])


def _members(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("repeated key")
    return found


def _no_number(word: str) -> None:
    raise ValueError(word)


def _whole(digits: str) -> int | float:
    return int(digits) if len(digits) < 40 else float(digits)


def reader() -> Callable[[str], Any]:
    """A function that gives the value of a JSON text, and ValueError for any other text."""
    strict = json.JSONDecoder(object_pairs_hook=_members, parse_constant=_no_number).decode
    with_long_numbers = json.JSONDecoder(object_pairs_hook=_members, parse_constant=_no_number, parse_int=_whole).decode

    def parsed(text: str) -> Any:
        try:
            return strict(text)
        except RecursionError as deep:
            raise ValueError("too deep") from deep
        except ValueError as error:
            if "integer string conversion" in str(error):
                return with_long_numbers(text)
            raise

    return parsed


def count_members(value: Any, counts: dict[tuple[str, str], int]) -> None:
    """Adds 1 per member of a value at any depth under (path, type). Elements of arrays share the path ``[]``."""
    level, depth = [("", value)] if value.__class__ is dict or value.__class__ is list else [], 0
    while level:
        depth += 1
        below = []
        for path, at in level:
            if at.__class__ is dict:
                members = [(f"{path}.{key}" if path else key, member) for key, member in at.items()]
            else:
                step = path + "[]"
                members = [(step, member) for member in at]
            for step, member in members:
                kind = _TYPES[member.__class__]
                if kind == "integer" and not -_LONGEST_INTEGER < member < _LONGEST_INTEGER:
                    kind = "number"
                counts[step, kind] = counts.get((step, kind), 0) + 1
                if kind == "object" or kind == "array":
                    below.append((step, member))
        if below and depth >= DEEPEST:
            raise ValueError("too deep")
        level = below


def path_counts(texts: DataFrame, *columns: str) -> DataFrame:
    """(column, path, type, n): how often a member of a type stands at a path, summed per task as far as memory allows.

    Malformed texts count under the empty path; null texts don't count. A text that stands in several columns
    of a row is opened once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[dict[tuple[str, str], int]] = [{} for _ in columns]
        parsed = reader()

        def passed() -> pa.RecordBatch:
            rows = [(name, *key, n) for name, some in zip(columns, counts) for key, n in some.items()]
            values = zip(*rows) if rows else [()] * len(_COUNTS)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(values, _COUNTS)], schema=_COUNTS)
            for some in counts:
                some.clear()
            return batch

        def members(text: str) -> dict[tuple[str, str], int]:
            found: dict[tuple[str, str], int] = {}
            try:
                count_members(parsed(text), found)
            except ValueError:
                found = {("", MALFORMED): 1}
            return found

        for batch in batches:
            for row in zip(*[column.to_pylist() for column in batch.columns]):
                opened: dict[str, dict[tuple[str, str], int]] = {}
                for text, some in zip(row, counts):
                    if text is None:
                        continue
                    found = opened.get(text)
                    if found is None:
                        found = opened[text] = members(text)
                    for key, n in found.items():
                        some[key] = some.get(key, 0) + n
                if sum(map(len, counts)) >= MOST_COUNTS:
                    yield passed()
        yield passed()

    return texts.select(*[F.col(c).cast("string") for c in columns]).mapInArrow(run, "column string, path string, type string, n bigint")


def member_test(test: Callable[[str | None, str, Any], bool]) -> Callable[[Column], Column]:
    """A function of a text column: does any member of any object pass ``test(parent key, key, value)``?

    The parent key is that of the object around the member, None for the outermost and for elements of
    arrays. Null and malformed texts have no members.
    """

    def holds(text: str | None, parsed: Callable[[str], Any]) -> bool:
        if text is None:
            return False
        try:
            level = [(None, parsed(text))]
        except ValueError:
            return False
        while level:
            below = []
            for parent, at in level:
                if at.__class__ is dict:
                    for key, member in at.items():
                        if test(parent, key, member):
                            return True
                        if member.__class__ is dict or member.__class__ is list:
                            below.append((key, member))
                elif at.__class__ is list:
                    below += [(None, member) for member in at if member.__class__ is dict or member.__class__ is list]
            level = below
        return False

    @F.arrow_udf(T.BooleanType())
    def run(texts: pa.Array) -> pa.Array:
        parsed = reader()
        return pa.array([holds(text, parsed) for text in texts.to_pylist()], pa.bool_())

    return run
