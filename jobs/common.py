"""What the jobs share: their command line, configuration and log."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

from pyspark.sql import SparkSession

log = logging.getLogger("granary.jobs")


def config(path: str | None, default: str, allowed: tuple[str, ...]) -> dict:
    """The settings of a JSON file on the machine that starts the job; an unknown name is an error."""
    with open(path or os.path.join(os.path.dirname(__file__), default), encoding="utf-8") as f:
        found = json.load(f)
    if unknown := set(found) - set(allowed):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return found


def start(doc: str, paths: dict[str, str], argv: list[str] | None) -> argparse.Namespace:
    """The arguments, each path required, and ``--config``; logs go to standard error."""
    p = argparse.ArgumentParser(description=doc, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name, what in paths.items():
        p.add_argument(f"--{name}", required=True, help=what)
    p.add_argument("--config", help="JSON file of settings; without it the one beside the job")
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    return p.parse_args(argv)


def session(name: str) -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
