"""Commands: ``python -m changelens index|status|prune``; each prints one JSON object or one a line."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from . import api


def main(args: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="changelens")
    commands = top.add_subparsers(dest="command", required=True)
    for name, text in (("index", "index a checkout, or refresh its index"), ("status", "tell the state of a checkout's index"), ("prune", "list indexes that nothing reaches")):
        one = commands.add_parser(name, help=text)
        if name != "prune":
            one.add_argument("root", help="the checkout")
            one.add_argument("--model", default="", help="the embedding model that the index is for")
        one.add_argument("--folder", required=True, help="where the indexes are")
        if name == "index":
            one.add_argument("--force", action="store_true", help="build anew")
        if name == "prune":
            one.add_argument("--apply", action="store_true", help="delete them")
    asked = top.parse_args(args)
    spark = SparkSession.builder.appName("changelens").getOrCreate()
    if asked.command == "index":
        print(json.dumps(api.index_repo(spark, asked.root, asked.folder, model=asked.model, force=asked.force)))
    elif asked.command == "status":
        print(api.index_status(spark, asked.root, asked.folder, asked.model).toJSON().first())
    else:
        rows, freed = api.prune_folder(spark, asked.folder, dry_run=not asked.apply)
        for row in [*rows.where("reason is not null").select("name", "reason", "size_bytes").toJSON().collect(), freed.toJSON().first()]:
            print(row)


if __name__ == "__main__":
    main()
