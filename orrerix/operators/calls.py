"""Calls of a service for every row of a table: so many at once, at a bounded rate, again after a failure.

Rows are dealt to so many partitions, and each has its share of the calls at once
and of the rate; a partition is one task at a time, so the job as a whole keeps
both bounds however few of its tasks run together, without anything that they
must ask.  A task holds the rows that are under way and a batch of results.
"""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A call: some rows in, a result for each out.
Ask = Callable[[list[dict]], list]


class Again(Exception):
    """Raised by a call that may be made again, after so many seconds if the service says so."""

    def __init__(self, why: str, after: float | None = None):
        super().__init__(why)
        self.after = after

    def __reduce__(self):
        return Again, (str(self), self.after)


class Refused(Exception):
    """Raised by a call that would fail again."""


@dataclass(frozen=True)
class Policy:
    """What a job may ask of a service: calls at once, calls a second, rows in a call, attempts, and seconds to wait, doubled each time up to the longest."""

    at_once: int = 40
    per_second: float | None = None
    rows: int = 1
    attempts: int = 5
    wait: float = 1.0
    longest: float = 60.0
    tasks: int = 8

    def __post_init__(self) -> None:
        if min(self.at_once, self.rows, self.attempts, self.tasks) < 1 or self.wait < 0 or (self.per_second is not None and self.per_second <= 0):
            raise ValueError(f"a policy needs positive numbers: {self}")

    @property
    def partitions(self) -> int:
        return min(self.tasks, self.at_once)

    def pause(self, attempt: int, key: bytes, after: float | None) -> float:
        """Seconds before the next attempt: what the service asked for, or the doubled wait less up to a quarter, so that rows that failed together don't come back together."""
        if after is not None:
            return min(after, self.longest)
        return min(self.longest, self.wait * 2**attempt) * (1 - 0.25 * (zlib.crc32(key) % 1000) / 1000)


class _Pace:
    """Gives out moments at a rate; whoever asks waits for the next one."""

    def __init__(self, per_second: float | None):
        self.gap, self.next, self.lock = 1 / per_second if per_second else 0.0, 0.0, threading.Lock()

    def wait(self) -> None:
        if not self.gap:
            return
        with self.lock:
            now = time.monotonic()
            at = max(now, self.next)
            self.next = at + self.gap
        time.sleep(max(0.0, at - now))


def _tried(ask: Ask, rows: list[dict], policy: Policy, pace: _Pace) -> list[tuple]:
    """(result, error, attempts) of each row: of a call for all of them, or one by one where that failed to the end."""
    why = ""
    for attempt in range(policy.attempts):
        after = None
        pace.wait()
        try:
            found = ask(rows)
            if len(found) != len(rows):
                raise Refused(f"{len(found)} results for {len(rows)} rows")
            return [(x, None, attempt + 1) for x in found]
        except Refused as e:
            why = str(e)
            break
        except Again as e:
            why, after = str(e), e.after
        except Exception as e:  # the row's error is its result
            why = f"{type(e).__name__}: {e}"
        if attempt + 1 < policy.attempts:
            time.sleep(policy.pause(attempt, repr(rows[0]).encode(), after))
    if len(rows) > 1:
        return [one for row in rows for one in _tried(ask, [row], policy, pace)]
    return [(None, why or "failed", attempt + 1)]


def called(df: DataFrame, ask: Ask, result: str | T.DataType, policy: Policy = Policy(), name: str = "result") -> DataFrame:
    """``df`` with a result of the given type, an error (null with a result) and the number of attempts of every row; rows come as they end.

    ``ask`` is picklable and takes rows as dictionaries by column; it raises
    ``Again`` to be asked later and ``Refused`` not to be asked again; any other
    exception counts as the former.  No row is lost: with its attempts used up
    it has its last error.
    """
    kind = T._parse_datatype_string(result) if isinstance(result, str) else result
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind), T.StructField("error", T.StringType()), T.StructField("attempts", T.IntegerType())])
    arrow = to_arrow_schema(schema)
    parts = policy.partitions
    share = policy.at_once // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace = _Pace(policy.per_second / parts if policy.per_second else None)
        ended: list[dict] = []

        def rows(done: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(done, schema=arrow)

        def end(some: set[Future]) -> None:
            for f in some:
                own = under_way.pop(f)
                ended.extend({**row, name: value, "error": error, "attempts": n} for row, (value, error, n) in zip(own, f.result(), strict=True))

        under_way: dict[Future, list[dict]] = {}
        with ThreadPoolExecutor(share) as pool:
            for batch in batches:
                for at in range(0, batch.num_rows, policy.rows):
                    some = batch.slice(at, policy.rows).to_pylist()
                    under_way[pool.submit(_tried, ask, some, policy, pace)] = some
                    if len(under_way) >= 2 * share:  # a call waits for each that runs
                        end(wait(under_way, return_when=FIRST_COMPLETED).done)
                    if len(ended) >= 1000:
                        yield rows(ended)
                        ended.clear()
            while under_way:
                end(wait(under_way, return_when=FIRST_COMPLETED).done)
        if ended:
            yield rows(ended)

    return df.repartition(parts).mapInArrow(run, schema)


def over_http(url: str, timeout: float = 60.0) -> Ask:
    """Post ``{"rows": [...]}`` and take ``{"results": [...]}``: too many requests and server errors are to be asked again, other errors aren't."""

    def ask(rows: list[dict]) -> list:
        body = json.dumps({"rows": rows}, default=str).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as answer:
                return json.load(answer)["results"]
        except urllib.error.HTTPError as e:
            after = e.headers.get("Retry-After")
            if e.code == 429 or e.code >= 500:
                raise Again(f"HTTP {e.code}", float(after) if after and after.replace(".", "", 1).isdigit() else None) from e
            raise Refused(f"HTTP {e.code}") from e

    return ask
