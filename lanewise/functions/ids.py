"""Content ids: SHA-256 over canonical JSON (sorted keys, no spaces, nothing escaped beyond what JSON must)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def content_id(text: Column, **metadata: Column) -> Column:
    """The id of a text with string metadata and no parents, as native functions; metadata must not be null."""
    fields = F.struct(*(metadata[k].cast("string").alias(k) for k in sorted(metadata)))
    whole = F.struct(fields.alias("metadata"), F.array().cast("array<string>").alias("parents"), text.alias("text"))
    return F.sha2(_lower_escapes(F.to_json(whole, {"ignoreNullFields": "false"})), 256)


def _lower_escapes(encoded: Column) -> Column:
    """Canonical JSON writes the few escapes with hexadecimal digits in lower case."""
    for code in range(0x20):
        if f"{code:04X}" != f"{code:04x}":
            encoded = F.replace(encoded, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}"))
    return encoded


def entity_tag(content: Column) -> Column:
    """The quoted digest that tells versions of a file apart."""
    return F.concat(F.lit('"'), F.md5(content), F.lit('"'))


def lock_name(key: Column) -> Column:
    return F.sha1(key)


def time_text(when: Column) -> Column:
    """A time as the commands show it."""
    return F.date_format(when, "yyyy-MM-dd HH:mm:ss")


def canonical(record: dict) -> str:
    return json.dumps(record, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def record_id(text: str | None, metadata: str | None, parents: list[str] | None, revision: int = 0) -> str:
    """The id of a text with metadata (JSON text) and parents, in a revision."""
    record = {"text": text, "metadata": json.loads(metadata) if metadata else {}, "parents": list(parents) if parents is not None else []}
    return hashlib.sha256(canonical(record | ({"revision": int(revision)} if revision else {})).encode()).hexdigest()


@F.pandas_udf(StringType())
def content_id_of_json(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The id of (text, metadata as JSON text, parents, revision) for metadata of any shape."""
    for columns in parts:
        yield pd.Series([record_id(*row) for row in zip(*columns)], dtype="object")
