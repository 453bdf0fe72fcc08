"""Settings of a job: its config file, with what the command line says on top."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path


def settings(name: str, about: str, argv: list[str] | None = None) -> dict:
    """The values of jobs/<name>.json, or of the file that --config names; every value can be given as an option too. ValueError-like exits have code 2."""
    own = Path(__file__).with_name(f"{name}.json")
    first = argparse.ArgumentParser(add_help=False)
    first.add_argument("--config", default=str(own))
    given, rest = first.parse_known_args(argv)
    known, told = json.loads(own.read_text()), json.loads(Path(given.config).read_text())
    p = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about, parents=[first])
    for key, value in known.items():
        p.add_argument(f"--{key.replace('_', '-')}", type=type(value) if value is not None else str, default=told.get(key, value))
    if unknown := set(told) - set(known):
        p.error(f"unknown settings: {sorted(unknown)}")
    out = {k: v for k, v in vars(p.parse_args(rest)).items() if k != "config"}
    if missing := [k for k, v in out.items() if v is None]:
        p.error(f"no value for {missing}")
    return out


def log_to_stderr() -> None:
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s - %(levelname)s - %(message)s")
