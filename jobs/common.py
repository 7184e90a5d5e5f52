"""What the jobs share: settings, logging, and a session that only the command line owns."""

from __future__ import annotations

import argparse
import logging
import tomllib
from collections.abc import Callable
from dataclasses import fields
from pathlib import Path

from routeloom import session

log = logging.getLogger("routeloom.jobs")


def load(kind: type, path: str | None = None):
    """The settings of a job from a TOML file on the driver, by default the one beside the job; unknown names are errors."""
    found = tomllib.loads(Path(path).read_text() if path else (Path(__file__).parent / f"{kind.FILE}.toml").read_text())
    if unknown := set(found) - {f.name for f in fields(kind)}:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return kind(**found)


def main(description: str, arguments: dict[str, str], kind: type, work: Callable[..., None]) -> None:
    """The command line: a path for each argument, ``--config`` and ``--master``; makes a session, works, stops it."""
    parser = argparse.ArgumentParser(description=description)
    for name, text in arguments.items():
        parser.add_argument(f"--{name}", required=True, help=text)
    parser.add_argument("--config", help="a TOML file of settings")
    parser.add_argument("--master", help="for runs outside spark-submit, such as local[8]")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    settings, spark = load(kind, given.pop("config")), session.build(given.pop("master"))
    try:
        session.let_workers_import(spark)
        work(spark, **given, settings=settings)
    finally:
        spark.stop()
