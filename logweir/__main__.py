"""python -m logweir init|batch|from-staging|stream: thin commands over the plans."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .plans import batch
from .session import build_session
from .sources.readers import read_files
from .streaming import ingest as stream


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="logweir")
    parser.add_argument("--store", required=True, help="folder of the tables")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (("init", "learn templates from past logs"), ("batch", "process files"), ("from-staging", "process staged NDJSON"), ("stream", "process files as they come")):
        command = commands.add_parser(name, help=text)
        command.add_argument("--input", required=True)
        if name == "stream":
            command.add_argument("--checkpoint", required=True)
            command.add_argument("--once", action="store_true", help="stop when all present files are done")
    args = parser.parse_args(argv)
    spark = build_session()
    store = batch.Store(spark, args.store)
    if args.command == "init":
        lines = spark.read.text(args.input).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"))
        print(f"{batch.learn_templates(store, lines)} new templates")
    elif args.command == "batch":
        print(batch.run_files(store, read_files(spark, args.input)))
    elif args.command == "from-staging":
        print(batch.run_staged(store, args.input))
    else:
        stream.start(store, stream.read_lines(spark, args.input), args.checkpoint, available_now=args.once).awaitTermination()


if __name__ == "__main__":
    main()
