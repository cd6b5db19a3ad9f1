"""Calls of a service that fails and throttles: the bounds hold and every row ends with a result or an error."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from orrerix.operators.calls import Again, Policy, Refused, _Pace, _tried, called, over_http


@pytest.fixture
def server():
    """Fails each key a number of times, refuses some for good, and notes how many calls are under way and when they began."""
    state = {"now": 0, "most": 0, "seen": Counter(), "starts": [], "lock": threading.Lock(), "hold": 0.02}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            rows = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["rows"]
            with state["lock"]:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
                state["starts"].append(time.monotonic())
                for r in rows:
                    state["seen"][r["k"]] += 1
                times = max(state["seen"][r["k"]] for r in rows)
            time.sleep(state["hold"])
            k = rows[0]["k"]
            code = 400 if any(r["k"] % 17 == 3 for r in rows) else 429 if k % 5 == 1 and times <= 2 else 500 if k % 7 == 2 else 200
            with state["lock"]:
                state["now"] -= 1
            self.send_response(code)
            if code == 429:
                self.send_header("Retry-After", "0.01")
            self.end_headers()
            if code == 200:
                self.wfile.write(json.dumps({"results": [r["k"] * 2.0 for r in rows]}).encode())

        def log_message(self, *_):
            pass

    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{made.server_address[1]}/"
    yield state
    made.shutdown()


def test_every_row_ends_and_no_more_calls_are_under_way_than_stated(spark, server):
    df = spark.range(300).selectExpr("id AS k", "cast(null as string) AS note")
    policy = Policy(at_once=12, attempts=3, wait=0.01, tasks=4)
    got = {r.k: r for r in called(df, over_http(server["url"]), "double", policy).collect()}
    assert set(got) == set(range(300)) and 4 < server["most"] <= 12
    for k, r in got.items():
        if k % 17 == 3:
            assert (r.result, r.error, r.attempts) == (None, "HTTP 400", 1)
        elif k % 5 == 1:
            assert (r.result, r.attempts) == ((k * 2.0, 3) if k % 7 != 2 else (None, 3))
        elif k % 7 == 2:
            assert (r.result, r.error, r.attempts) == (None, "HTTP 500", 3) and server["seen"][k] == 3
        else:
            assert (r.result, r.error, r.attempts) == (k * 2.0, None, 1) and server["seen"][k] == 1


def test_rate_of_all_tasks_together(spark, server):
    server["hold"] = 0
    called(spark.range(40).selectExpr("id * 35 AS k"), over_http(server["url"]), "double", Policy(at_once=20, per_second=40, tasks=4)).collect()
    starts = sorted(server["starts"])
    assert len(starts) == 40
    for i in range(len(starts)):
        assert sum(starts[i] <= t < starts[i] + 0.5 for t in starts) <= 20 + 4  # and one of each task that had none yet


def test_batches_that_fail_are_asked_row_by_row(spark, server):
    df = spark.range(100).selectExpr("id AS k").coalesce(1)
    got = {r.k: r for r in called(df, over_http(server["url"]), "double", Policy(rows=10, attempts=2, wait=0.001, tasks=2)).collect()}
    assert set(got) == set(range(100))
    assert all((r.error == "HTTP 400") == (k % 17 == 3) for k, r in got.items()) and sum(r.result is not None for r in got.values()) > 60


def test_policy_and_attempts():
    calls = []

    def ask(rows):
        calls.append(rows)
        raise Again("busy", 0.0)

    assert _tried(ask, [{"k": 1}], Policy(attempts=4), _Pace(None)) == [(None, "busy", 4)] and len(calls) == 4

    def refuse(rows):
        raise Refused("no")

    assert _tried(refuse, [{"k": 1}], Policy(), _Pace(None)) == [(None, "no", 1)]
    assert _tried(lambda rows: [], [{"k": 1}], Policy(), _Pace(None)) == [(None, "0 results for 1 rows", 1)]
    pauses = [Policy(wait=1, longest=5).pause(k, b"x", None) for k in range(5)]
    assert pauses == sorted(pauses) and pauses[-1] <= 5 and Policy().pause(0, b"x", 7.0) == 7.0 and Policy(longest=3).pause(0, b"x", 7.0) == 3
    for wrong in ({"at_once": 0}, {"attempts": 0}, {"per_second": 0}):
        with pytest.raises(ValueError, match="positive"):
            Policy(**wrong)


def test_structs_and_empty_tables(spark):
    ask = lambda rows: [{"score": len(r["t"]), "why": r["t"]} for r in rows]
    df = spark.createDataFrame([("a",), ("bcd",)], "t string")
    assert {(r.t, r.found.score, r.found.why) for r in called(df, ask, "score int, why string", name="found").collect()} == {("a", 1, "a"), ("bcd", 3, "bcd")}
    assert called(df.limit(0), ask, "score int, why string").collect() == []
