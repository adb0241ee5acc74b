"""OPENJSON: documents as rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import EngineError
from tessera.functions.json import path_steps


class _Number(str):
    """A number with its spelling."""


def _code(value: object) -> int:
    """Type codes: null 0, string 1, number 2, true or false 3, array 4, object 5."""
    if value is None:
        return 0
    if isinstance(value, _Number):
        return 2
    if isinstance(value, bool):
        return 3
    return 1 if isinstance(value, str) else 5 if isinstance(value, _Pairs) else 4


class _Pairs(list):
    """An object's pairs in order, with those of equal names."""


def _text(value: object) -> str | None:
    if isinstance(value, bool):
        return "true" if value else "false"
    if value is None or isinstance(value, str):
        return value
    return _dump(value)


def _dump(value: object) -> str:
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, _Pairs):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_dump(v)}" for k, v in value) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_dump, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def _parsed(text: str) -> object:
    try:
        return json.loads(text, object_pairs_hook=_Pairs, parse_int=_Number, parse_float=_Number)
    except ValueError:
        raise EngineError(13609, "JSON text is not properly formatted") from None


def _rows(text: str | None, strict: bool, steps: list) -> Iterator[tuple[str, str | None, int]]:
    if text is None:
        return
    value = _parsed(text)
    for step in steps:
        if isinstance(step, str) and isinstance(value, _Pairs) and any(k == step for k, _ in value):
            value = next(v for k, v in value if k == step)
        elif isinstance(step, int) and isinstance(value, list) and not isinstance(value, _Pairs) and step < len(value):
            value = value[step]
        elif strict:
            raise EngineError(13608, "property cannot be found on the specified JSON path")
        else:
            return
    if isinstance(value, _Pairs):
        pairs = list(value)
    elif isinstance(value, list):
        pairs = [(str(i), v) for i, v in enumerate(value)]
    elif strict:
        raise EngineError(13611, "value referenced by JSON path is not an array or object")
    else:
        return
    for k, v in pairs:
        yield k, _text(v), _code(v)


def openjson(df: DataFrame, doc: str, keep: list[str], path: str = "$") -> DataFrame:
    """CROSS APPLY OPENJSON(doc[, path]): columns of keep, key, value, type; equal names and spellings of numbers stay."""
    strict, steps = path_steps(path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys, values, types = [], [], [], []
            for i, text in enumerate(batch.column(len(keep)).to_pylist()):
                for k, v, t in _rows(text, strict, steps):
                    at.append(i)
                    keys.append(k)
                    values.append(v)
                    types.append(t)
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(len(keep))), pa.array(keys, pa.string()), pa.array(values, pa.string()), pa.array(types, pa.int32())], [*keep, "key", "value", "type"])

    source = df.select(*keep, F.col(doc).cast("string").alias("__doc"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[: len(keep)]), "key string, value string, type int"])
    return source.mapInArrow(rows, schema)


def openjson_with(df: DataFrame, doc: str, keep: list[str], columns: dict[str, tuple[str, str | None, bool]], array: bool = True, path: str = "$") -> DataFrame:
    """OPENJSON(doc, path) WITH (name type 'path' [AS JSON]): name to (Spark type, path or None for $.name, whether AS JSON).

    Stays with built-in functions: array elements are exploded as variants and each column is taken by its path.
    """
    whole = F.variant_get(F.parse_json(F.col(doc)), _dollar(path), "variant")
    items = df.select(*keep, F.explode(F.variant_get(F.parse_json(F.col(doc)), _dollar(path), "array<variant>")).alias("__v")) if array else df.select(*keep, whole.alias("__v"))
    out: list[Column] = []
    for name, (kind, own, as_json) in columns.items():
        value = F.try_variant_get("__v", _dollar(own or f"$.{name}"), "variant" if as_json else kind)
        out.append((F.to_json(value) if as_json else value).alias(name))
    return items.select(*keep, *out)


def _dollar(path: str) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f'["{s}"]' for s in path_steps(path)[1])
