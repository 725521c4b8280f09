"""A replayable log as a streaming source: entries with an id and JSON data, so many in each batch.

The log is a text file with one entry a line (``id`` tab ``data``), or any store for which ``entries`` is overridden. An
offset is the place in bytes where the next entry begins, so a batch reads its own part of the log only, whatever came
before, and a lost batch is read again from the same place.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

BATCH = 20


class EntryLogReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.batch = options["path"], int(options.get("batch", BATCH))

    def initialOffset(self) -> dict:
        return {"byte": 0}

    def entries(self, start: int, end: int | None = None) -> tuple[list[tuple[str, str]], int]:
        """Entries from byte ``start`` up to byte ``end``, or a batch of them; and where the next one begins.

        A line that has no end yet is left for a later batch. Empty lines are passed over.
        """
        out: list[tuple[str, str]] = []
        with open(self.path, "rb") as f:
            f.seek(start)
            while start < end if end is not None else len(out) < self.batch:
                line = f.readline()
                if not line.endswith(b"\n"):
                    break
                start += len(line)
                if line.strip():
                    entry_id, _, data = line.decode().rstrip("\n").partition("\t")
                    out.append((entry_id, data))
        return out, start

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found, end = self.entries(start["byte"])
        return iter(found), {"byte": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self.entries(start["byte"], end["byte"])[0])

    def commit(self, end: dict) -> None:
        pass


class EntryLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "entry_log"

    def schema(self) -> str:
        return "id string, data string"

    def simpleStreamReader(self, schema) -> EntryLogReader:
        return EntryLogReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EntryLog)
