"""A stream's predictions after failures, its memory of pairs, and a service that answers in part."""

import pandas as pd
import pytest

from orrerix.operators.calls import Policy, Refused
from orrerix.streaming.incremental import PredictionTable

PAIRS = "inchi string, property_token long"


@pytest.fixture
def table(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def scorer(batch: pd.DataFrame) -> pd.Series:
        for i, t in zip(batch["inchi"], batch["property_token"], strict=True):
            with (log / f"{i}-{t}").open("a") as f:
                f.write("x")
        return batch["property_token"] / 10.0

    made = PredictionTable(spark, str(tmp_path / "p"), scorer)
    made.asked_for = lambda: {p.name: len(p.read_text()) for p in log.iterdir()}
    return made


def test_a_batch_that_is_played_again_adds_no_row(spark, table, tmp_path):
    batch = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], PAIRS)
    table.answer(batch, "s-0")
    table.answer(batch, "s-0")
    assert sorted(map(tuple, table.rows().collect())) == [("a", 1, 0.1), ("b", 2, 0.2)] and table.asked_for() == {"a-1": 1, "b-2": 1}
    # a write that was cut off: files without the mark of the end
    table.answer(batch.unionByName(spark.createDataFrame([("c", 3)], PAIRS)), "s-1")
    (tmp_path / "p" / "made-s-1" / "_SUCCESS").unlink()
    table.answer(spark.createDataFrame([("a", 1), ("c", 3), ("d", 4)], PAIRS), "s-1")
    assert sorted(map(tuple, table.rows().collect())) == [("a", 1, 0.1), ("b", 2, 0.2), ("c", 3, 0.3), ("d", 4, 0.4)]


def test_appends_with_a_name_replace_and_others_add(spark, table):
    one = lambda v: spark.createDataFrame([("a", 1, v)], PAIRS + ", positive_prediction double")
    table.append(one(0.5), "x")
    table.append(one(0.7), "x")
    table.append(one(0.1))
    assert sorted(r.positive_prediction for r in table.rows().collect()) == [0.1, 0.7] and table.view().first().positive_prediction == pytest.approx(0.4)


def test_pairs_are_remembered_by_the_stream(spark, table, tmp_path):
    source = str(tmp_path / "requests")

    def ask(*rows):
        spark.createDataFrame([(*r[:2], pd.Timestamp(r[2]).to_pydatetime()) for r in rows], PAIRS + ", at timestamp").coalesce(1).write.mode("append").parquet(source)

    ask(("a", 1, "2024-01-01 10:00"), ("a", 1, "2024-01-01 10:01"))
    stream = spark.readStream.schema(PAIRS + ", at timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    run = table.follow(stream, str(tmp_path / "check"), at="at", remember="10 minutes")
    try:
        run.processAllAvailable()
        ask(("a", 1, "2024-01-01 10:05"), ("b", 1, "2024-01-01 10:05"))
        run.processAllAvailable()
        assert table.asked_for() == {"a-1": 1, "b-1": 1} and table.rows().count() == 2
        state = [s for p in run.recentProgress for s in p["stateOperators"]]
        assert any(s["operatorName"] == "dedupeWithinWatermark" and s["numRowsTotal"] == 2 for s in state)
    finally:
        run.stop()


def test_a_service_answers_in_part(spark, table):
    def ask(rows):
        if rows[0]["property_token"] == 2:
            raise Refused("unknown token")
        return [0.25 for _ in rows]

    pairs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], PAIRS)
    failed = table.asked(pairs, ask, Policy(at_once=4, tasks=2))
    assert [tuple(r) for r in failed.collect()] == [("a", 2, "unknown token", 1)]
    assert sorted(map(tuple, table.rows().collect())) == [("a", 1, 0.25), ("b", 1, 0.25)]
