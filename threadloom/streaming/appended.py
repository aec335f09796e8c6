"""Files that grow, read from where they were left, each with a state of its own.

``observe`` lists a folder into a table of observations (path, size, modified, seen), which a stream
reads; ``appended`` follows it with a cursor for each file. Bytes are read up to the observed size
only, so a replay reads the same. A last line without its end stays unread until it has one. States:

- 'active': lines up to the cursor were given; 'deferred': only an unfinished line is there;
- 'retry_pending': it couldn't be read; tried again after a wait that doubles with each failure;
- 'excluded': it failed ``most`` times and is left alone until it is replaced.

A file that became shorter, or whose beginning is another, was replaced and is read anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from threadloom.sources.packed import _open

OBSERVED = "path string, size long, modified long, seen long"
LINES = "path string, event string, at long, line string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HEAD, CHUNK = 1024, 4 << 20
FAILURES, WAIT_MS = 5, 1000


def observe(spark: SparkSession, folder: str, to: str) -> None:
    """Adds what a folder holds now to the observations; files are listed, not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    seen = F.unix_millis(F.current_timestamp())
    files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified"), seen.alias("seen")).write.mode("append").json(to)


class _Follow(StatefulProcessor):
    def __init__(self, most: int, wait_ms: int):
        self.most, self.wait_ms = most, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.file = handle.getValueState("file", "cursor long, head string, head_size long, state string, failures int, retry_at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values(["seen", "size"])  # one short row for each listing in the batch
        kept = self.file.get() if self.file.exists() else (0, "", 0, "absent", 0, 0)
        cursor, head, head_size, state, failures, retry_at = kept
        for size, now in zip(seen["size"].tolist(), seen["seen"].tolist(), strict=True):
            if state == "retry_pending" and now < retry_at:
                continue
            before, found = state, None
            try:
                with _open(key[0]) as f:
                    replaced = size < cursor or hashlib.sha256(f.read(head_size)).hexdigest() != head if head_size else False
                    if state == "excluded" and not replaced:
                        continue
                    if replaced:
                        cursor, head_size, failures = 0, 0, 0
                        yield self._event(key[0], "replaced", 0)
                    for found in self._lines(f, key[0], cursor, size):
                        cursor = int(found["at"].iloc[-1]) + int(found["length"].iloc[-1])
                        yield found[["path", "event", "at", "line"]]
                    if cursor and head_size < HEAD:
                        f.seek(0)
                        head_size = min(cursor, HEAD)
                        head = hashlib.sha256(f.read(head_size)).hexdigest()
                state, failures = "active" if cursor else "deferred" if size else "active", 0
            except (OSError, ValueError):
                if state == "excluded":
                    continue
                failures += 1
                state = "excluded" if failures >= self.most else "retry_pending"
                retry_at = now + self.wait_ms * 2**failures
            if state != before:
                yield self._event(key[0], state, cursor)
        self.file.update((cursor, head, head_size, state, failures, retry_at))

    def _event(self, path: str, name: str, at: int) -> pd.DataFrame:
        return pd.DataFrame({"path": [path], "event": [name], "at": [at], "line": [None]})

    def _lines(self, f, path: str, start: int, stop: int) -> Iterator[pd.DataFrame]:
        """Finished lines from ``start`` on and before ``stop``, a frame for each chunk."""
        held, at = b"", start
        f.seek(start)
        while at + len(held) < stop:
            more = f.read(min(CHUNK, stop - at - len(held)))
            if not more:
                return
            *lines, held = (held + more).split(b"\n")
            if lines:
                length = [len(x) + 1 for x in lines]
                begin = [at]
                for n in length[:-1]:
                    begin.append(begin[-1] + n)
                yield pd.DataFrame({"path": path, "event": "line", "at": begin, "line": [x.decode("utf-8", "replace") for x in lines], "length": length})
                at = begin[-1] + length[-1]

    def close(self) -> None:
        pass


def appended(observed: DataFrame, most: int = FAILURES, wait_ms: int = WAIT_MS) -> DataFrame:
    """(path, event, at, line): new lines with their places in bytes, and changes of a file's state. The session's state store must be ``ROCKS``."""
    return observed.groupBy("path").transformWithStateInPandas(_Follow(most, wait_ms), outputStructType=LINES, outputMode="Append", timeMode="None")
