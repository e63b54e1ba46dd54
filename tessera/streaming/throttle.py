"""Login attempts throttled as a stream: who failed too often is locked out for a while.

Each server keeps its own book of attempts, with an entry for each address
and each device, as many entries at most as its capacity. An attempt is about
two identities at once, and what it does depends on both, so a server's
attempts are taken one after the other; servers are independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Failures until an identity is locked, seconds of a lock and of an entry's life, seconds between prunings, entries.
FAILURES, LOCKED, PRUNED, CAPACITY = 5, 3600, 60, 10_000

RESULT = "server string, attempt_id long, decision string, retry_after long"


class Throttle(StatefulProcessor):
    """Entries by identity: failures, locked_until (0: not locked) and expires_at; and when entries were last pruned, and their number."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        entry = T.StructType([T.StructField(n, T.LongType()) for n in ("failures", "locked_until", "expires_at")])
        self.entries = handle.getMapState("entries", T.StructType([T.StructField("identity", T.StringType())]), entry)
        self.book = handle.getValueState("book", T.StructType([T.StructField("pruned_at", T.LongType()), T.StructField("held", T.LongType())]))

    def _get(self, identity: str) -> tuple[int, int, int] | None:
        return tuple(self.entries.getValue((identity,))) if self.entries.containsKey((identity,)) else None

    def _evict(self, now: int) -> bool:
        """Makes room: of the entries that aren't locked the one that expires first goes (ties: the least identity)."""
        free = [(e[2], k[0]) for k, e in self.entries.iterator() if e[1] <= now]
        if not free:
            return False
        self.entries.removeKey((min(free)[1],))
        self.held -= 1
        return True

    def _fail(self, identity: str, now: int) -> int:
        """Counts a failure; until when the identity is locked by that, or 0. Without room nothing is counted."""
        entry = self._get(identity)
        if entry is None:
            if self.held >= self.capacity and not self._evict(now):
                return 0
            self.held += 1
        elif entry[1] > now:
            return entry[1]
        failures = 1 + (entry[0] if entry and not entry[1] else 0)
        until = now + LOCKED if failures >= FAILURES else 0
        self.entries.updateValue((identity,), (failures, until, now + LOCKED))
        return until

    def _attempt(self, address: str, device: str, good: bool, now: int) -> tuple[str, int]:
        identities = [f"ip:{address}", f"device:{device}"]
        for identity in identities:
            entry = self._get(identity)
            if entry and entry[1] > now:
                return "locked", max(1, entry[1] - now)
        if good:
            for identity in identities:
                if self._get(identity):
                    self.entries.removeKey((identity,))
                    self.held -= 1
            return "accepted", 0
        for identity in identities:
            if until := self._fail(identity, now):
                return "locked", max(1, until - now)
        return "refused", 0

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempts = pd.concat(list(rows)).sort_values(["at", "attempt_id"])
        pruned_at, self.held = self.book.get() if self.book.exists() else (0, 0)
        out = []
        for r in attempts.itertuples():
            if r.at - pruned_at >= PRUNED:
                for identity, entry in list(self.entries.iterator()):
                    if entry[2] <= r.at:
                        self.entries.removeKey(identity)
                        self.held -= 1
                pruned_at = r.at
            out.append((key[0], r.attempt_id, *self._attempt(r.address, r.device, r.good, r.at)))
        self.book.update((int(pruned_at), self.held))
        yield pd.DataFrame(out, columns=["server", "attempt_id", "decision", "retry_after"])

    def close(self) -> None:
        pass


def throttled(attempts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """attempts (server, attempt_id, at: epoch seconds, address, device, good) as a stream: server, attempt_id, decision
    (accepted, refused or locked), retry_after (seconds, 0 unless locked).

    A micro-batch's attempts of a server are taken in order of time; later
    micro-batches come after it. The state store must be one that holds maps (RocksDB).
    """
    return attempts.groupBy("server").transformWithStateInPandas(Throttle(capacity), outputStructType=RESULT, outputMode="append", timeMode="none")
