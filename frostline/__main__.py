"""python -m frostline build --profile p.yaml --output dir | serve dir..."""

from __future__ import annotations

import argparse
import logging
from dataclasses import replace

from pyspark.sql import SparkSession

from frostline import server
from frostline.plans import stage
from frostline.plans.catalog import Catalog
from frostline.sources import profile
from frostline.streaming.reload import Watcher


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="frostline")
    parser.add_argument("--debug", action="store_true")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build")
    build.add_argument("--profile", required=True)
    build.add_argument("--output", required=True)
    build.add_argument("--input", help="instead of the profile's path")
    build.add_argument("--memory", help="driver memory, such as 8g")
    build.add_argument("--threads", type=int, help="local threads, where no cluster is configured")
    build.add_argument("--postings", action="store_true", help="a table of the documents of each token")
    build.add_argument("--bins", action="store_true", help="quantile bins of numbers")
    build.add_argument("--keep", type=int, default=2, help="versions that stay")
    serve = commands.add_parser("serve")
    serve.add_argument("paths", nargs="*", default=["data_out"])
    serve.add_argument("--http-addr", default="127.0.0.1:3001")
    given = parser.parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if given.debug else logging.INFO)

    builder = SparkSession.builder.appName("frostline").config("spark.sql.session.timeZone", "UTC")
    if given.command == "build":
        builder = builder.config("spark.driver.memory", given.memory) if given.memory else builder
        spark = (builder.master(f"local[{given.threads}]") if given.threads else builder).getOrCreate()
        own = profile.load(given.profile)
        done = stage.build(spark, replace(own, path=given.input) if given.input else own, given.output, given.postings, given.bins, given.keep)
        logging.info("%s: %d documents", own.collection, done.size)
        return
    spark = builder.getOrCreate()
    catalog = Catalog(spark, given.paths)
    watcher = Watcher(catalog).start()
    host, _, port = given.http_addr.rpartition(":")
    try:
        server.serve(catalog, host, int(port)).serve_forever()
    finally:
        watcher.stop()


if __name__ == "__main__":
    main()
