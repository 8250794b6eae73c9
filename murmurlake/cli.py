"""Command line: parse, scan, links, fingerprints of chat exports; filter and export activities from Parquet."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from murmurlake.operators import candidates, filters, fingerprint
from murmurlake.sources import chat, sinks


def build(spark: SparkSession, command: str, path: str, min_confidence: float, max_messages: int | None) -> DataFrame:
    messages = chat.parse_chats(chat.read_chats(spark, path))
    if command == "parse":
        return messages
    if command == "stats":
        return chat.parse_stats(messages)
    if command == "scan":
        return candidates.quick_scan(messages, min_confidence, max_messages)[0]
    if command == "links":
        return candidates.activity_links(messages)
    return fingerprint.month_chunks(messages)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="murmurlake", description=__doc__)
    parser.add_argument("command", choices=("parse", "stats", "scan", "links", "fingerprints", "filter", "export"))
    parser.add_argument("input", help="a text file, an archive, or a folder of them")
    parser.add_argument("-o", "--output", help="folder for Parquet; without it the first rows are shown")
    parser.add_argument("--min-confidence", type=float, default=0.5)
    parser.add_argument("--max-messages", type=int)
    parser.add_argument("--formats", nargs="+", default=["csv", "json"], choices=sinks.KINDS)
    parser.add_argument("--config", help="settings as a JSON object; options typed here go before them")
    for lead in ("export", "pdf"):
        for name in ("categories", "countries", "from"):
            parser.add_argument(f"--{lead}-{name}", nargs="+", default=[])
        for name in ("start-date", "end-date"):
            parser.add_argument(f"--{lead}-{name}")
        for name in ("only-locations", "only-generic"):
            parser.add_argument(f"--{lead}-{name}", action="store_true")
        parser.add_argument(f"--{lead}-min-score", type=float)
        parser.add_argument(f"--{lead}-max-activities", type=int, default=0)
        parser.add_argument(f"--{lead}-sort", default="score", choices=("score", "oldest", "newest"))
    args = parser.parse_args(argv)
    if args.command == "export" and not args.output:
        parser.error("export needs --output")
    spark = SparkSession.builder.appName("murmurlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command in ("filter", "export"):
        config = {}
        if args.config:
            config = json.loads("".join(r["value"] for r in spark.read.text(args.config, wholetext=True).collect()))
        activities = spark.read.parquet(args.input)
        if args.command == "export":
            for kind, path in sinks.write_exports(activities, args.output, args.formats, vars(args), config).items():
                print(kind, path)
            return
        made = filters.select_activities(activities, filters.filter_of("csv", vars(args), config))
    else:
        made = build(spark, args.command, args.input, args.min_confidence, args.max_messages)
    if args.output:
        made.write.mode("overwrite").parquet(args.output)
    else:
        made.show(50, truncate=100)


if __name__ == "__main__":
    main()
