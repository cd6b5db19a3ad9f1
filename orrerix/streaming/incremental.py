"""Predictions kept in a table and made only where they are missing, in batches or as a stream of requests."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.calls import Ask, Policy, called
from ..scratch import stored
from ..sources.sinks import exists

SCHEMA = "inchi string, property_token long, positive_prediction double"
Scorer = Callable[[pd.DataFrame], pd.Series]


class PredictionTable:
    """Rows (inchi, property_token, positive_prediction) in a Parquet folder; writers append, readers average.

    A scorer is a picklable function of a batch of pairs, which runs on the
    executors with retries by Spark; a pair that is scored twice does no harm.
    Every append has a folder of its own under the table's, so one that is made
    again under the same name takes the place of the first.
    """

    def __init__(self, spark: SparkSession, path: str, scorer: Scorer):
        self.spark, self.path, self.scorer = spark, path, scorer

    def rows(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(self.path)

    def view(self) -> DataFrame:
        """One row for each pair: the average of its predictions."""
        return self.rows().groupBy("inchi", "property_token").agg(F.avg("positive_prediction").alias("positive_prediction"))

    def append(self, predictions: DataFrame, name: str | None = None) -> None:
        """Add predictions, under a name instead of what was added under it before."""
        predictions.select("inchi", "property_token", "positive_prediction").write.mode("overwrite").parquet(f"{self.path}/made-{name or uuid.uuid4().hex}")

    def scored(self, pairs: DataFrame) -> DataFrame:
        scorer = self.scorer

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(positive_prediction=scorer(batch))

        return pairs.select(F.col("inchi").cast("string"), F.col("property_token").cast("long")).distinct().mapInPandas(run, SCHEMA)

    def missing(self, pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("inchi").cast("string"), F.col("property_token").cast("long")).distinct()
        return wanted.join(self.rows(), ["inchi", "property_token"], "left_anti")

    def predict(self, pairs: DataFrame) -> DataFrame:
        """Predictions of all pairs: known ones as they are, missing ones made and kept first."""
        self.append(self.scored(self.missing(pairs)))
        return self.view().join(pairs.select(F.col("inchi").cast("string"), F.col("property_token").cast("long")).distinct(), ["inchi", "property_token"], "left_semi")

    def predict_all(self, entities: DataFrame, tokens: DataFrame) -> DataFrame:
        """Predictions of every token for entities(inchi): an entity that lacks any token is scored anew as a whole."""
        from ..operators.relational import any_missing, product

        lacking = any_missing(entities, tokens, self.rows(), "inchi", "property_token")
        self.append(self.scored(product(lacking, tokens.select("property_token").distinct())))  # the pairs are what is to be scored
        return self.view().join(entities.select("inchi").distinct(), "inchi", "left_semi")

    def asked(self, pairs: DataFrame, ask: Ask, policy: Policy = Policy()) -> DataFrame:
        """Ask a service for the missing pairs and keep its predictions; the pairs that ended in an error, with it."""
        made = stored(called(self.missing(pairs), ask, "double", policy, "positive_prediction"), "asked")
        self.append(made.where("error is null"))
        return made.where("error is not null").select("inchi", "property_token", "error", "attempts")

    def follow(self, requests: DataFrame, checkpoint: str, at: str | None = None, remember: str = "1 hour") -> StreamingQuery:
        """Score a stream of pairs as they come, each micro-batch against what the table has by then.

        A micro-batch is appended under its number: one that is played again
        after a failure adds no row.  With a time column ``at`` of the requests,
        pairs are remembered as keyed state for so long after they were asked
        for; those that come again within it don't reach the table's join.
        """
        if at is not None:
            requests = requests.withWatermark(at, remember).dropDuplicatesWithinWatermark(["inchi", "property_token"])
        stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
        return requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: self.answer(batch, f"{stream}-{number}")).start()

    def answer(self, batch: DataFrame, name: str) -> None:
        """Score the missing pairs of a micro-batch once: what was added under its name to the end stays, and what was begun is made anew."""
        folder = f"{self.path}/made-{name}"
        if exists(self.spark, f"{folder}/_SUCCESS"):
            return
        if exists(self.spark, folder):
            target = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        self.append(self.scored(self.missing(batch)), name)
