"""Conditions on metadata that is JSON text of any shape."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _equals(value: Column, wanted: Any) -> Column:
    """Whether a JSON value (a variant, null if missing) is equal to a Python one, as Python compares what it parses:
    numbers by value, whatever their kind, True as 1 and False as 0, texts with texts alone."""
    kind = F.schema_of_variant(value)
    if wanted is None:
        return value.isNull() | F.is_variant_null(value)
    if isinstance(wanted, (bool, int, float)):
        number = F.coalesce(F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "boolean").cast("double"))
        same = number == F.lit(float(wanted))
        if isinstance(wanted, int) and abs(wanted) >= 1 << 53:  # beyond what a double tells apart
            same = F.try_variant_get(value, "$", "decimal(38,0)") == F.lit(str(int(wanted))).cast("decimal(38,0)")
        return kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)") & same
    if isinstance(wanted, str):
        return (kind == "STRING") & (F.try_variant_get(value, "$", "string") == wanted)
    return kind.rlike("^(OBJECT|ARRAY)") & (F.to_json(value) == json.dumps(wanted, sort_keys=True, ensure_ascii=False, separators=(",", ":")))


def equal_to(column: str, wanted: dict[str, Any]) -> Column:
    """Whether all these keys have these values; a missing key has the value None."""
    values = F.from_json(F.coalesce(F.col(column), F.lit("{}")), "map<string,variant>")
    return reduce(Column.__and__, (F.coalesce(_equals(F.try_element_at(values, F.lit(k)), v), F.lit(False)) for k, v in wanted.items()), F.lit(True))
