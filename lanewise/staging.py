"""Writes that wait for a commit.

Records of lists of texts stay on the driver, up to INLINE of them and their bytes up to BYTES; more than that, and
records of DataFrames, are written as Parquet to the folder that all executors share. However many writes wait, what they
are read with is one scan and one local table, so the plans of later writes and of the commit don't grow with them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lanewise.sources.files import Files, shared_folder

INLINE, BYTES = 10_000, 8 << 20
#: A staged record: an embedding where the caller gave one and no payload yet.
STAGED = "fid string, base string, revision int, op string, text string, metadata string, parents array<string>, created_at double, embedding array<double>"
NAMES = [c.split()[0] for c in STAGED.split(", ")]


@dataclass
class Ledger:
    spark: SparkSession
    rows: list[tuple] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    writes: int = 0
    bytes: int = 0
    folder: str | None = None

    def __bool__(self) -> bool:
        return bool(self.rows or self.parts)

    def mark(self) -> tuple[int, int, int, int]:
        return len(self.rows), len(self.parts), self.writes, self.bytes

    def back_to(self, mark: tuple[int, int, int, int]) -> None:
        """Forget what was staged after mark."""
        rows, parts, self.writes, self.bytes = mark
        del self.rows[rows:]
        del self.parts[parts:]

    def _part(self) -> str:
        if self.folder is None:
            self.folder = f"{shared_folder(self.spark)}/staged-{uuid.uuid4().hex}"
        return f"{self.folder}/{len(self.parts):06d}-{uuid.uuid4().hex[:8]}"

    def add(self, records: list[tuple]) -> None:
        """Records of a list, in the order of STAGED. Those that don't fit on the driver are written as a part."""
        size = sum(len(r[4] or "") + len(r[5] or "") + 8 * len(r[8] or ()) for r in records)
        if len(self.rows) + len(records) > INLINE or self.bytes + size > BYTES:
            self.add_frame(self.spark.createDataFrame(records, STAGED))
            return
        self.rows += records
        self.bytes += size

    def add_frame(self, records: DataFrame) -> None:
        part = self._part()
        records.select(*NAMES).write.parquet(part)
        self.parts.append(part)

    def local(self) -> DataFrame:
        """What waits on the driver."""
        return self.spark.createDataFrame(self.rows, STAGED).coalesce(1)

    def written(self) -> DataFrame:
        """What waits in parts."""
        return self.spark.read.schema(STAGED).parquet(*self.parts) if self.parts else self.spark.createDataFrame([], STAGED)

    def frame(self) -> DataFrame:
        """All that waits."""
        return self.local().unionByName(self.written()) if self.parts else self.local()

    def known(self, bases: set[str]) -> tuple[dict[str, set[int]], set[str]]:
        """Of the records on the driver: the revisions of some contents that were forgotten, and the ids that were put."""
        gone: dict[str, set[int]] = {}
        put = set()
        for fid, base, revision, op, *_ in self.rows:
            if base in bases:
                if op == "put":
                    put.add(fid)
                else:
                    gone.setdefault(base, set()).add(revision)
        return gone, put

    def clear(self) -> None:
        """What waited has been committed or dropped."""
        self.rows, self.parts, self.writes, self.bytes = [], [], 0, 0
        if self.folder is not None:
            Files(self.spark, self.folder).delete("")
            self.folder = None
