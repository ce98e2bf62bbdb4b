"""A row sink for databases without a Spark connector: rows go in statements by number or age, and each epoch once."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any


class FlushingWriter:
    """For ``writeStream.foreach``. ``connect`` gives a connection (DB-API) where a task runs; named columns are appended, others left out.

    Rows are sent once there are ``rows`` of them or the oldest has waited ``seconds``, all of a task's epoch in one transaction. It
    also notes (partition, epoch) in the table ``<table>_epochs``; an epoch that is noted is passed over when Spark runs it again.
    A source that can be replayed gives each task the same rows again as long as its partitions stay the same.
    """

    def __init__(self, connect: Callable[[], Any], table: str, columns: list[str], rows: int = 5, seconds: float = 1.0, mark: str = "?", clock: Callable[[], float] = time.monotonic):
        self.connect, self.table, self.columns, self.rows, self.seconds, self.mark, self.clock = connect, table, columns, rows, seconds, mark, clock

    def open(self, partition_id: int, epoch_id: int) -> bool:
        self.held: list[tuple] = []
        self.since, self.at, self.skip = 0.0, (partition_id, epoch_id), False
        self.connection = self.connect()
        cursor = self.connection.cursor()
        cursor.execute(f"CREATE TABLE IF NOT EXISTS {self.table}_epochs (part INTEGER, epoch BIGINT, PRIMARY KEY (part, epoch))")
        self.connection.commit()
        cursor.execute(f"SELECT 1 FROM {self.table}_epochs WHERE part = {self.mark} AND epoch = {self.mark}", self.at)
        self.skip = cursor.fetchone() is not None
        return not self.skip

    def process(self, row: Any) -> None:
        now = self.clock()
        if not self.held:
            self.since = now
        self.held.append(tuple(row[c] for c in self.columns))
        if len(self.held) >= self.rows or now - self.since >= self.seconds:
            self._flush()

    def close(self, error: Exception | None) -> None:
        try:
            if self.skip:
                return
            if error is not None:
                self.connection.rollback()
                return
            self._flush()
            self.connection.cursor().execute(f"INSERT INTO {self.table}_epochs VALUES ({self.mark}, {self.mark})", self.at)
            self.connection.commit()
        finally:
            self.connection.close()

    def _flush(self) -> None:
        if self.held:
            self.connection.cursor().executemany(f"INSERT INTO {self.table} ({', '.join(self.columns)}) VALUES ({', '.join([self.mark] * len(self.columns))})", self.held)
            self.held = []
