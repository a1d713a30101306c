"""Configurations, problems, caps, terms and solutions as JSON text, and back.

A dataclass is written as its name and fields; arrays and tables of bounded size (a
solution's) keep their shape and schema.  Reading builds only the classes below, and
each class's own `validate` still decides whether its values are sound.
"""

from __future__ import annotations

import dataclasses
import json
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from . import config, problem
from .errors import InvalidConfig
from .operators import cap, solver, terms

KINDS = {c.__name__: c for module in (config, problem, cap, terms, solver) for c in vars(module).values() if isinstance(c, type) and dataclasses.is_dataclass(c)}


def _plain(value: Any) -> Any:
    if dataclasses.is_dataclass(value) and type(value).__name__ in KINDS:
        return {"kind": type(value).__name__, "fields": {f.name: _plain(getattr(value, f.name)) for f in dataclasses.fields(value) if f.init}}
    if isinstance(value, DataFrame):
        return {"schema": value.schema.jsonValue(), "rows": [[_plain(v) for v in row] for row in value.collect()]}
    if isinstance(value, np.ndarray):
        return {"array": value.tolist(), "shape": list(value.shape)}
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, (tuple, list)):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {"map": {k: _plain(v) for k, v in value.items()}}
    return value


def _built(value: Any, spark: SparkSession | None) -> Any:
    if isinstance(value, list):
        return tuple(_built(v, spark) for v in value)
    if not isinstance(value, dict):
        return value
    if "array" in value:
        return np.array(value["array"], dtype=np.float64).reshape(value["shape"])
    if "schema" in value:
        if spark is None:
            raise InvalidConfig("a table is read with a session only")
        return spark.createDataFrame([tuple(r) for r in value["rows"]], StructType.fromJson(value["schema"]))
    if "map" in value:
        return {k: _built(v, spark) for k, v in value["map"].items()}
    if value.get("kind") not in KINDS:
        raise InvalidConfig(f"unknown kind {value.get('kind')}")
    try:
        return KINDS[value["kind"]](**{k: _built(v, spark) for k, v in value["fields"].items()})
    except (KeyError, TypeError) as wrong:
        raise InvalidConfig(f"{value['kind']}: {wrong}") from wrong


def dumps(value: Any) -> str:
    """The value as JSON; floats are written so that they read back equal."""
    return json.dumps(_plain(value))


def loads(text: str, spark: SparkSession | None = None) -> Any:
    """The value that `dumps` wrote; tables need a session."""
    try:
        plain = json.loads(text)
    except json.JSONDecodeError as wrong:
        raise InvalidConfig(f"no JSON: {wrong}") from wrong
    return _built(plain, spark)
