"""python -m kinfold.cli --config jobs.yaml archive --job old_orders"""

from __future__ import annotations

import argparse
import json
import logging
import sys

from kinfold import config as configs
from kinfold.engine import Engine, plan_text

VERSION = "0.1.0"
LEVELS = {"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR}


class _Json(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"level": record.levelname.lower(), "ts": self.formatTime(record), "msg": record.getMessage()})


def set_up_logging(c: configs.Logging) -> logging.Logger:
    """To stdout, stderr or a file; a file is also echoed to stdout unless file_only."""
    log = logging.getLogger("kinfold")
    for h in log.handlers[:]:
        log.removeHandler(h)
    if c.output in ("", "stdout", "stderr"):
        handlers: list[logging.Handler] = [logging.StreamHandler(sys.stderr if c.output == "stderr" else sys.stdout)]
    else:
        handlers = [logging.FileHandler(c.output), *([] if c.file_only else [logging.StreamHandler(sys.stdout)])]
    for h in handlers:
        h.setFormatter(_Json() if c.format == "json" else logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(h)
    log.setLevel(LEVELS[c.level or "info"])
    return log


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinfold")
    p.add_argument("--config", "-c", default="kinfold.yaml")
    p.add_argument("--log-level", default="", choices=["", *LEVELS])
    p.add_argument("--log-format", default="", choices=["", "json", "text"])
    p.add_argument("--skip-verify", action="store_true")
    p.add_argument("--version", action="version", version=VERSION)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("archive", "copy-only", "purge", "dry-run", "validate", "plan", "list-jobs", "version"):
        s = sub.add_parser(name)
        if name in ("archive", "copy-only", "purge", "dry-run", "plan"):
            s.add_argument("--job", "-j", required=True)
        if name == "validate":
            s.add_argument("--job", "-j")
        if name in ("archive", "copy-only", "purge"):
            s.add_argument("--force", action="store_true")
            s.add_argument("--skip-validate-preflight", action="store_true")
        if name in ("archive", "purge", "validate"):
            s.add_argument("--force-triggers", action="store_true")
        if name == "copy-only":
            s.add_argument("--yes", action="store_true", help="do not ask before --force")
    return p


def main(argv: list[str] | None = None, session=None) -> int:
    a = parser().parse_args(argv)
    if a.command == "version":
        print(VERSION)
        return 0
    c = configs.load(a.config).with_overrides(log_level=a.log_level, log_format=a.log_format, skip_verify=a.skip_verify)
    if a.command == "list-jobs":
        for name, job in sorted(c.jobs.items()):
            print(f"{name}\t{job.root_table}\t{job.where}")
        return 0
    configs.validate(c)
    if a.command == "plan":
        print(plan_text(c, a.job))
        return 0
    log = set_up_logging(c.job_logging(a.job) if getattr(a, "job", None) else c.logging)
    from pyspark.sql import SparkSession

    spark = session or SparkSession.builder.appName("kinfold").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, c)
    if a.command == "dry-run":
        for r in engine.dry_run(a.job).collect():
            print("\t".join(map(str, r)))
        return 0
    if a.command == "validate":
        rows = engine.validate(a.job, a.force_triggers).collect()
        for r in rows:
            print("\t".join(map(str, r)))
        return int(not all(r.ok for r in rows))
    if a.command == "copy-only" and a.force and not a.yes and input("Copy into tables that are not empty? [y/N] ").strip().lower() != "y":
        return 1
    if session is None:
        engine.stop.install()
    if c.replication.enabled and engine.health is None:
        log.error("replication is enabled, and this command has no reader for the state of its servers")
        return 1
    flags = {"force": a.force, "skip_preflight": a.skip_validate_preflight}
    if a.command != "copy-only":
        flags["force_triggers"] = a.force_triggers
    stats = getattr(engine, a.command.replace("-", "_"))(a.job, **flags)
    log.info("done: %s", stats)
    return 0


if __name__ == "__main__":
    sys.exit(main())
