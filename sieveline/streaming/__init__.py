"""Continuous scans: a stream of documents in, streams of findings and of changes out."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from sieveline.functions import text as X
from sieveline.operators import findings as P
from sieveline.operators import scanners

STATE = StructType([StructField("seen", ArrayType(StringType()))])
CHANGES = "doc_id long, fingerprint string, delta_status string"


def scan_stream(docs: DataFrame, scan: Callable[[DataFrame], DataFrame] = scanners.check_pii) -> DataFrame:
    """The findings of a stream of documents; scanners are narrow, so an append stream stays one."""
    return scan(docs)


def sink(found: DataFrame, path: str, checkpoint: str, marks: Callable[[], DataFrame] | None = None):
    """Writes findings batch by batch; a batch that is written again replaces itself, so each counts once.

    ``marks`` gives the false positives as they are; it is asked anew for each batch, so that a mark counts from the next one.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = P.annotate_marks(batch, marks()) if marks else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return found.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()


class Kept:
    """A static table that a stream meets, read again once it is older than ``hours``."""

    def __init__(self, read: Callable[[], DataFrame], hours: float = 24.0, clock: Callable[[], float] = time.time) -> None:
        self._read, self._seconds, self._clock = read, hours * 3600, clock
        self._at: float | None = None

    def __call__(self) -> DataFrame:
        now = self._clock()
        if self._at is None or now - self._at > self._seconds:
            self._table, self._at = self._read(), now
        return self._table


class Progress(StreamingQueryListener):
    """Tells of each batch: its number, the rows read and the milliseconds that it took."""

    def __init__(self, tell: Callable[[int, int, int], None]) -> None:
        self._tell = tell

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._tell(p.batchId, p.numInputRows, p.batchDuration)

    def onQueryTerminated(self, event) -> None:
        pass


class Changes(StatefulProcessor):
    """Per document: the fingerprints of its latest version; emits what is new, unchanged or removed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getValueState("seen", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = {f for part in rows for f in part["fingerprint"] if f}
        before = set(self._seen.get()[0] or []) if self._seen.exists() else set()
        self._seen.update((sorted(now),))
        out = [(key[0], f, "new" if f not in before else "unchanged") for f in sorted(now)]
        out += [(key[0], f, "removed") for f in sorted(before - now)]
        yield pd.DataFrame(out, columns=["doc_id", "fingerprint", "delta_status"])

    def close(self) -> None:
        pass


def delta_stream(versions: DataFrame, scan: Callable[[DataFrame], DataFrame] = scanners.scan_code) -> DataFrame:
    """Changes between the versions of each document; a version without findings still counts as one.

    Needs the RocksDB state store, which keeps state larger than memory.
    """
    found = scan(versions).select("doc_id", X.fingerprint().alias("fingerprint"))
    rows = found.unionByName(versions.select("doc_id", F.lit("").alias("fingerprint")))
    return rows.groupBy("doc_id").transformWithStateInPandas(Changes(), CHANGES, "Append", "None")


def windowed_counts(found: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Findings by event-time window and severity, with a watermark."""
    return found.withWatermark(ts, late).groupBy(F.window(ts, width), "severity").agg(F.count("*").alias("n"))
