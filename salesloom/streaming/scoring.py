"""Scoring a stream of transactions: the batch functions on each micro-batch.

The job keeps no state. A micro-batch is one write, partitioned by outcome: a batch that is
replayed after a failure overwrites its own folder as a whole, so scored and rejected
records always stem from the same run of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from salesloom.operators.features import split_valid, validate
from salesloom.operators.scoring import score_classify, score_combined, score_priority, score_regress
from salesloom.operators.training import Model
from salesloom.sources.transactions import stream_transactions


def scorer(models: dict[str, Model]) -> tuple[str, Callable[[DataFrame], DataFrame]]:
    """Record kind and scoring function for the models given by task."""
    if {"profit_class", "profit_amount"} <= models.keys():
        return "profit", lambda f: score_combined(f, models["profit_class"], models["profit_amount"])
    if "profit_class" in models:
        return "profit", lambda f: score_classify(f, models["profit_class"])
    if "profit_amount" in models:
        return "profit", lambda f: score_regress(f, models["profit_amount"])
    task = "urgency" if "urgency" in models else "priority"
    return "priority", lambda f: score_priority(f, models[task])


def score_records(records: DataFrame, models: dict[str, Model]) -> tuple[DataFrame, DataFrame]:
    """Scored valid records, and rejected ones with their reasons."""
    kind, score = scorer(models)
    valid, rejected = split_valid(validate(records, kind))
    return score(valid), rejected


def score_stream(
    spark: SparkSession,
    source: str,
    models: dict[str, Model],
    out: str,
    fmt: str = "json",
    checkpoint: str | None = None,
    files_per_batch: int | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Score the files arriving in ``source`` to ``out/records/batch=N/outcome=scored|rejected``.

    Stops after the files at hand unless ``every`` names a trigger interval.
    """
    kind, _ = scorer(models)
    records = stream_transactions(spark, source, kind, fmt, files_per_batch)

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # both outcomes read it: the files are parsed once
        try:
            scored, rejected = score_records(batch, models)
            both = scored.withColumn("outcome", F.lit("scored")).unionByName(rejected.withColumn("outcome", F.lit("rejected")), allowMissingColumns=True)
            both.write.mode("overwrite").partitionBy("outcome").parquet(f"{out}/records/batch={number}")
        finally:
            batch.unpersist()

    place = checkpoint or f"{out}/_progress"
    return (
        records.writeStream.foreachBatch(write)
        .option("checkpointLocation", place)
        .trigger(**({"processingTime": every} if every else {"availableNow": True}))
        .start()
    )
