"""JSON: tests, extraction by path, editing, construction.

Paths have the dialect's modes: lax gives null where strict raises. Reading stays with built-in functions; editing keeps
the rest of a document as it is and needs a (vectorised) Python function.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import EngineError

_STEP = re.compile(r"""\.(?:([A-Za-z_][A-Za-z0-9_]*)|"((?:[^"\\]|\\.)*)")|\[(\d+|\*)\]""")


def path_steps(path: str) -> tuple[bool, list[str | int]]:
    """Whether a path is strict, and its steps; error 13607 for a bad path."""
    text = path.strip()
    strict = text.startswith("strict ")
    text = re.sub(r"^(strict|lax)\s+", "", text)
    if not text.startswith("$"):
        raise EngineError(13607, f"JSON path {path} is not properly formatted")
    steps, at = [], 1
    while at < len(text):
        m = _STEP.match(text, at)
        if not m:
            raise EngineError(13607, f"JSON path {path} is not properly formatted")
        name, quoted, index = m.groups()
        steps.append(name if name is not None else json.loads(f'"{quoted}"') if quoted is not None else -1 if index == "*" else int(index))
        at = m.end()
    return strict, steps


def _spark_path(steps: list[str | int]) -> str:
    return "$" + "".join(f"[{'*' if s == -1 else s}]" if isinstance(s, int) else f"['{s}']" for s in steps)


def _variant(x: Column) -> Column:
    return F.try_parse_json(x)


def isjson(x: Column, kind: str | None = None) -> Column:
    """ISJSON: 1 for an object or array (or the kind asked for), 0 else, null for null."""
    first = F.substring(F.ltrim(F.regexp_replace(x, r"^\s+", "")), 1, 1)
    good = _variant(x).isNotNull()
    shape = {None: first.isin("{", "["), "VALUE": F.lit(True), "ARRAY": first == "[", "OBJECT": first == "{", "SCALAR": ~first.isin("{", "[")}[kind and kind.upper()]
    return F.when(x.isNull(), F.lit(None).cast("int")).when(good & shape, 1).otherwise(0)


def _fail(strict: bool, number: int, message: str) -> Column:
    return F.raise_error(F.lit(f"tessera-error-{number}: {message}")).cast("string") if strict else F.lit(None).cast("string")


def _found(x: Column, path: str) -> tuple[bool, Column]:
    strict, steps = path_steps(path)
    return strict, F.get_json_object(x, _spark_path(steps)) if steps else x


def json_value(x: Column, path: str) -> Column:
    """JSON_VALUE: the scalar at the path; objects, arrays and what is longer than 4000 units give null, or an error if strict."""
    strict, found = _found(x, path)
    shape = F.schema_of_variant(F.try_variant_get(_variant(x), _variant_path(path), "variant"))
    nested = shape.startswith("OBJECT") | shape.startswith("ARRAY")
    if not strict:  # only what looks like an object or array is parsed a second time, as a text may look so too
        return F.when((found.startswith("{") | found.startswith("[")) & nested | (F.length(found) > 4000), F.lit(None).cast("string")).otherwise(found)
    return F.when(nested, _fail(strict, 13623, "scalar value cannot be found")).when(F.length(found) > 4000, _fail(strict, 13625, "value is too long")).when(found.isNull() & shape.isNull(), F.when(x.isNotNull(), _fail(strict, 13608, "property cannot be found"))).otherwise(found)


def _variant_path(path: str) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f'["{s}"]' for s in path_steps(path)[1])


def json_query(x: Column, path: str = "$") -> Column:
    """JSON_QUERY: the object or array at the path; a scalar gives null, or an error if strict."""
    strict, found = _found(x, path)
    return F.when(F.ltrim(found).rlike(r"^\s*[\[{]"), found).otherwise(F.when(x.isNotNull(), _fail(strict, 13624, "object or array cannot be found")))


def json_path_exists(x: Column, path: str) -> Column:
    """JSON_PATH_EXISTS: 1 or 0; a JSON null is there."""
    _, steps = path_steps(path)
    if -1 in steps:
        there = F.get_json_object(x, _spark_path(steps)).isNotNull()
    else:
        there = F.schema_of_variant(F.try_variant_get(_variant(x), _variant_path(path), "variant")).isNotNull()
    return F.when(x.isNull(), F.lit(None).cast("int")).otherwise(there.cast("int"))


def _edit(doc: object, steps: list[str | int], value: object, strict: bool, append: bool, delete: bool) -> object:
    """The document with the value put at the path."""
    if not steps:
        if append and isinstance(doc, list):
            return [*doc, value]
        return value
    step, rest = steps[0], steps[1:]
    if isinstance(step, int):
        if not isinstance(doc, list) or step > len(doc) or (step == len(doc) and strict):
            if strict:
                raise EngineError(13608, "property cannot be found on the specified JSON path")
            return doc
        out = list(doc)
        if step == len(doc):
            return out if rest or delete else [*out, value]
        out[step] = None if delete and not rest else _edit(out[step], rest, value, strict, append, delete)
        return out
    if not isinstance(doc, dict) or (step not in doc and (strict or rest)):
        if strict:
            raise EngineError(13608, "property cannot be found on the specified JSON path")
        return doc
    out = dict(doc)
    if not rest and delete:
        out.pop(step, None)
    elif not rest and append:
        old = out.get(step)
        if old is None:
            out[step] = [value]
        elif isinstance(old, list):
            out[step] = [*old, value]
        elif strict:
            raise EngineError(13621, "array cannot be found in the specified JSON path")
    else:
        out[step] = _edit(out.get(step), rest, value, strict, append, delete)
    return out


def json_modify(x: Column, path: str, value: Column, is_json: bool = False) -> Column:
    """JSON_MODIFY with lax, strict and append; a null deletes in lax mode. White space comes out canonical."""
    append = path.strip().startswith("append ")
    strict, steps = path_steps(re.sub(r"^\s*append\s+", "", path))

    def edited(docs: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for doc, v in zip(docs, values, strict=True):
            if doc is None:
                out.append(None)
                continue
            gone = v is None or v != v
            new = None if gone else json.loads(v) if is_json else v.item() if hasattr(v, "item") else v
            out.append(json.dumps(_edit(json.loads(doc), steps, new, strict, append, gone and not strict and not append), separators=(",", ":"), ensure_ascii=False))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(edited, "string")(x, value)


def json_object(*pairs: tuple[str, Column], absent_on_null: bool = False) -> Column:
    """JSON_OBJECT: nulls are kept unless they are to be absent."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in pairs]), {"ignoreNullFields": str(absent_on_null).lower()})


def json_array(*values: Column, null_on_null: bool = False) -> Column:
    """JSON_ARRAY of values of one type: nulls are left out unless they are to be kept."""
    items = F.array(*values)
    return F.to_json(items if null_on_null else F.filter(items, lambda v: v.isNotNull()))
