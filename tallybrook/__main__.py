"""Command line: python -m tallybrook <job> ..., or spark-submit with the package on the path.

  stream   messages to warehouse, counters, quarantine, bronze and daily totals, until stopped
           or one of its streams fails, which ends the others;
           scored by the model of the train job where there is one, else by the rules
  daily    new bronze files to the clean table and the summaries of the days they touch
  train    fit, save and evaluate the fraud model on the clean table's source labels
  fold     sum up the live counters of past batches
  frames   print the dashboard frames
"""

from __future__ import annotations

import argparse
import datetime as dt
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tallybrook.operators.model import load_model, score_with_model
from tallybrook.plans import dashboard, jobs
from tallybrook.session import build_session
from tallybrook.sources.tables import job_messages
from tallybrook.streaming import queries as streams
from tallybrook.streaming.sinks import Targets, fold_counters
from tallybrook.streaming.supervision import supervise


def targets_of(root: str) -> Targets:
    """Default sinks of the stream below the same folder."""
    return Targets(
        warehouse=f"{root}/warehouse/transactions",
        counters=f"{root}/counters/deltas",
        quarantine=f"{root}/quarantine/stream",
        bronze=f"{root}/bronze/transactions",
        ids=f"{root}/warehouse/ids",
        commits=f"{root}/warehouse/commits",
    )


def parse_arguments(argv: list[str] | None = None) -> argparse.Namespace:
    """Arguments of all jobs."""
    parser = argparse.ArgumentParser(prog="tallybrook", description=__doc__)
    jobs_ = parser.add_subparsers(dest="job", required=True)
    stream = jobs_.add_parser("stream")
    stream.add_argument("--format", default="kafka", help="source format with a value column")
    stream.add_argument("--option", action="append", default=[], metavar="KEY=VALUE")
    stream.add_argument("--interval", default=streams.COUNTER_INTERVAL, help="'' = take all, end")
    daily = jobs_.add_parser("daily")
    daily.add_argument("--run-date", type=dt.date.fromisoformat, help="redo just this date")
    jobs_.add_parser("train")
    jobs_.add_parser("fold")
    jobs_.add_parser("frames")
    for job in jobs_.choices.values():
        job.add_argument("--root", required=True, help="folder of all tables")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    """Run one job."""
    given = parse_arguments(argv)
    spark = spark or build_session(f"tallybrook {given.job}")
    root, lake = given.root, jobs.lake_at(given.root)
    if given.job == "stream":
        options = dict(option.split("=", 1) for option in given.option)
        own = streams.stream_session(spark)
        messages = job_messages(own, given.format, options)
        interval = given.interval or None
        score = partial(score_with_model, model=load_model(spark, f"{root}/model"))
        checkpoint = f"{root}/checkpoints/stream"
        query = streams.fan_out_sink(messages, targets_of(root), checkpoint, interval, score)
        if not interval:
            streams.finish(query)
        totals = jobs.stream_totals(own, messages, root, interval)
        if interval:
            supervise([query, *totals])
    elif given.job == "daily" and given.run_date:
        show(jobs.run_daily(spark, lake, [given.run_date]))
    elif given.job == "daily":
        jobs.catch_up(spark, lake)
    elif given.job == "fold":
        fold_counters(spark, targets_of(root).counters, f"{root}/counters/baseline")
    elif given.job == "train":
        labelled = jobs.source_labels(spark.read.parquet(lake.silver))
        for frame in jobs.train(spark, labelled, f"{root}/model").values():
            show(frame)
    else:
        frames = dashboard.live_frames(spark, targets_of(root).counters, f"{root}/counters/baseline")
        for frame in [*frames.values(), *dashboard.history_frames(spark, lake.gold).values()]:
            show(frame)


def show(frame: DataFrame) -> None:
    """Print all rows of a report."""
    kept = frame.persist()
    kept.show(max(1, kept.count()), truncate=False)
    kept.unpersist()


if __name__ == "__main__":
    main()
