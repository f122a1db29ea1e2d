"""Commands: python -m parley daily|departments|trial-log|board ..."""

from __future__ import annotations

import argparse
import datetime
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession

from parley.plans import hotspots
from parley.session import build_session
from parley.sources import readers, services, synthetic
from parley.sources.tables import Store


def past_day(text: str) -> str:
    """A date in the form 2024-01-31 that is over."""
    day = datetime.date.fromisoformat(text) if len(text) == 10 else None
    if day is None or day >= datetime.date.today():
        raise ValueError(f"{text} is no day that is over")
    return text


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="parley", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    yesterday = str(datetime.date.today() - datetime.timedelta(days=1))
    for name, told in (("daily", "the company's board of a day"), ("departments", "boards of departments"), ("board", "shows a board as JSON lines")):
        one = commands.add_parser(name, help=told)
        one.add_argument("--root", required=True, help="folder of the result tables")
        one.add_argument("--date", type=past_day, default=yesterday)
    daily = commands.choices["daily"]
    daily.add_argument("--log", required=True, nargs="+", help="Parquet files of the message log")
    daily.add_argument("--force", action="store_true", help="embed all texts again")
    daily.add_argument("--dictionary", help="a file of Han words, a word a line")
    departments = commands.choices["departments"]
    departments.add_argument("--roster", help="Parquet files of (department, manager)")
    departments.add_argument("--url", help="the roster service")
    departments.add_argument("--department", nargs="*", default=[], help="departments that the service is asked for")
    commands.choices["board"].add_argument("--department")
    trial = commands.add_parser("trial-log", help="writes a made-up log")
    trial.add_argument("--out", required=True)
    trial.add_argument("--dialogues", type=int, default=10_000)
    trial.add_argument("--start", default="2024-01-01")
    trial.add_argument("--days", type=int, default=30)
    trial.add_argument("--seed", type=int, default=42)
    return out


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = spark or build_session(app=f"parley {a.command}")
    if a.command == "trial-log":
        synthetic.synthetic_log(spark, a.dialogues, a.seed, a.start, a.days).write.mode("overwrite").partitionBy("shard").parquet(a.out)
        for r in synthetic.log_statistics(spark.read.parquet(a.out)).orderBy("create_date").collect():
            print(json.dumps({"date": r.create_date, "messages": r.messages, "texts": r.texts, "senders": r.senders}))
        return
    store = Store(spark, a.root)
    if a.command == "daily":
        words = [r.word for r in readers.read_words(spark, a.dictionary).collect()] if a.dictionary else None  # a bounded lexicon
        print(hotspots.run_daily(store, readers.read_log(spark, a.log), a.date, han=bool(words), force=a.force, dictionary=words))
    elif a.command == "departments":
        if bool(a.roster) == bool(a.url):
            raise SystemExit("either --roster or --url")
        roster = spark.read.parquet(a.roster) if a.roster else services.read_roster(spark, a.url, a.department)
        for r in hotspots.run_departments(store, roster, a.date).orderBy("department").collect():
            print(json.dumps({"department": r.department, "topics": r.topics}))
    else:
        board = hotspots.board(store, a.date, "department", a.department) if a.department else hotspots.board(store, a.date)
        for row in board.toJSON().collect():  # a board's top_n rows
            print(row)


if __name__ == "__main__":
    main()
