"""JSON values: strict parsing with defaulting accessors, and the number rule of the output."""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def get_string(text: Column | str, path: str, default: str = "") -> Column:
    """String at a path such as $.a.b of a JSON column; the default for errors and other types."""
    value = F.try_parse_json(_c(text))
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    return F.when(F.coalesce(kind, F.lit("")) == "STRING", F.try_variant_get(value, path, "string")).otherwise(F.lit(default))


def get_number(text: Column | str, path: str, default: float = 0.0) -> Column:
    """Number at a path; the default for errors and other types."""
    value = F.try_parse_json(_c(text))
    kind = F.coalesce(F.schema_of_variant(F.try_variant_get(value, path, "variant")), F.lit(""))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(value, path, "double")).otherwise(F.lit(default))


def get_bool(text: Column | str, path: str, default: bool = False) -> Column:
    value = F.try_parse_json(_c(text))
    kind = F.coalesce(F.schema_of_variant(F.try_variant_get(value, path, "variant")), F.lit(""))
    return F.when(kind == "BOOLEAN", F.try_variant_get(value, path, "boolean")).otherwise(F.lit(default))


def parse(text: str) -> tuple[Any, str]:
    """(value, '') or (None, what is wrong): one whole document, trailing data refused. Objects are
    lists of pairs inside, so that order and duplicate keys stay; find() gives the first."""

    def constant(name: str) -> float:
        raise ValueError(f"unexpected {name}")

    try:
        return json.loads(text, object_pairs_hook=Object, parse_constant=constant), ""
    except (ValueError, RecursionError) as e:
        return None, str(e) or type(e).__name__


class Object(list):
    """Ordered pairs of a JSON object."""

    def find(self, key: str) -> Any:
        return next((v for k, v in self if k == key), None)

    def set(self, key: str, value: Any) -> None:
        for i, (k, _) in enumerate(self):
            if k == key:
                self[i] = (key, value)
                return
        self.append((key, value))


def as_string(value: Any, default: str = "") -> str:
    return value if isinstance(value, str) else default


def as_number(value: Any, default: float = 0.0) -> float:
    return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else default


def as_bool(value: Any, default: bool = False) -> bool:
    return value if isinstance(value, bool) else default


def number(x: float) -> str:
    """Whole numbers without a point, others with six significant digits."""
    if math.isfinite(x) and x == int(x) and abs(x) < 9.2e18:
        return str(int(x))
    return "null" if not math.isfinite(x) else f"{x:.6g}"


def dump(value: Any, pretty: bool = False, level: int = 0) -> str:
    """Text of a value: compact, or indented by two spaces. Non-ASCII characters stay raw."""
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, int | float):
        return number(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, dict | Object):
        pairs = value.items() if isinstance(value, dict) else value
        parts = [json.dumps(k, ensure_ascii=False) + (": " if pretty else ":") + dump(v, pretty, level + 1) for k, v in pairs]
        opened, closed = "{}"
    else:
        parts = [dump(v, pretty, level + 1) for v in value]
        opened, closed = "[]"
    if not parts:
        return opened + closed
    if not pretty:
        return opened + ",".join(parts) + closed
    inner = "\n" + "  " * (level + 1)
    return opened + inner + ("," + inner).join(parts) + "\n" + "  " * level + closed
