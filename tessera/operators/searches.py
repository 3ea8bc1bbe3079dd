"""Searches that go on while others begin: steps of bounded size, pages, and revisions of which only the latest counts."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.entries import filtered_entries, fresh

#: Entries and bytes of a step, matches after which a search stops, rows of a page at most.
STEP, STEP_BYTES, MOST_MATCHES, MOST_PAGE = 200, 8 << 20, 2_097_152, 200


def step(df: DataFrame, order: str, raw: str, query: str, after=None, mode: str = "decoded") -> DataFrame:
    """The next entries after a cursor with their outcome: at most 200, and those that begin within 8 MiB.

    A filter and a top-k; the sums are over these few rows. The next cursor is the largest ``order`` of the rows; a step without rows is the end.
    """
    (bytes_,) = fresh(df, "bytes")
    rest = df if after is None else df.where(F.col(order) > F.lit(after))
    few = rest.orderBy(order).limit(STEP)
    size = F.octet_length(raw).cast("long")
    sized = few.withColumn(bytes_, F.sum(size).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - size)
    return filtered_entries(sized.where(F.col(bytes_) < STEP_BYTES).drop(bytes_), raw, query, mode)


class Search:
    """A search over entries in steps: ``advance`` makes one, ``matches`` has the cursors of what was found, ``counts`` how many entries had which outcome."""

    def __init__(self, df: DataFrame, order: str, raw: str, query: str, mode: str = "decoded", most: int = MOST_MATCHES):
        self.df, self.order, self.raw, self.query, self.mode, self.most = df, order, raw, query, mode, most
        self.after, self.done, self.matches, self.counts = None, False, [], {}

    def advance(self) -> bool:
        """Whether there may be more."""
        if self.done:
            return False
        rows = step(self.df, self.order, self.raw, self.query, self.after, self.mode).select(self.order, "outcome").orderBy(self.order).collect()  # a step's rows
        for r in rows:
            self.counts[r["outcome"]] = self.counts.get(r["outcome"], 0) + 1
            if r["outcome"] == "matched" and len(self.matches) < self.most:
                self.matches.append(r[self.order])
        self.after = rows[-1][self.order] if rows else self.after
        self.done = not rows or len(self.matches) >= self.most
        return not self.done

    def page(self, start: int = 0, limit: int = MOST_PAGE) -> list:
        if not 0 < limit <= MOST_PAGE:
            raise ValueError(f"a page has 1 to {MOST_PAGE} rows")
        return self.matches[start : start + limit]


class Stale(RuntimeError):
    """A later revision has begun."""


class Revisions:
    """Requests of which only the latest counts: a new one interrupts the jobs of the one before, and what that still gives is refused.

    Requests run in threads whose Spark jobs carry a tag of their own.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.name, self.revision, self.lock = spark, uuid.uuid4().hex, 0, threading.Lock()
        self.latest: Request | None = None

    def tag(self, revision: int) -> str:
        return f"{self.name}-{revision}"

    def begin(self, make: Callable[[], DataFrame], limit: int = MOST_PAGE) -> Request:
        """Starts a request for the first rows of what ``make`` gives, and cancels the one before."""
        with self.lock:
            before, self.revision = self.latest, self.revision + 1
            request = self.latest = Request(self, self.revision, make, min(limit, MOST_PAGE))
        self.stop(before)
        request.thread.start()
        return request

    def stop(self, request: Request | None) -> None:
        """Interrupts a request's jobs, also those that it is about to start, until it has ended."""

        def until_ended() -> None:
            while request.thread.is_alive():
                self.spark.sparkContext.cancelJobsWithTag(self.tag(request.revision))
                time.sleep(0.1)

        if request is not None and request.thread.is_alive():
            threading.Thread(target=until_ended, daemon=True).start()

    def cancel(self) -> None:
        """No request counts any more until the next one."""
        with self.lock:
            before, self.latest, self.revision = self.latest, None, self.revision + 1
        self.stop(before)


class Request:
    def __init__(self, owner: Revisions, revision: int, make: Callable[[], DataFrame], limit: int):
        self.owner, self.revision, self.rows, self.error = owner, revision, None, None

        def run() -> None:
            context = owner.spark.sparkContext
            context.addJobTag(owner.tag(revision))
            try:
                if owner.revision == revision:
                    self.rows = make().limit(limit).collect()
            except Exception as e:  # noqa: BLE001  told to whoever asks for the result
                self.error = e
            finally:
                context.removeJobTag(owner.tag(revision))

        self.thread = InheritableThread(target=run)

    def result(self, timeout: float | None = None) -> list[Row]:
        """The rows, once they are there; Stale if a later request has begun or this one was cancelled."""
        ends = None if timeout is None else time.monotonic() + timeout
        while self.thread.is_alive() and self.owner.revision == self.revision and (ends is None or time.monotonic() < ends):
            self.thread.join(0.1)
        if self.owner.revision != self.revision:
            raise Stale(f"revision {self.revision} was overtaken by {self.owner.revision}")
        if self.thread.is_alive():
            raise TimeoutError
        if self.error is not None:
            raise self.error
        return self.rows
