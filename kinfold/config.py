"""Job configuration: YAML to dataclasses, defaults, per-job overrides, and a validation that reports every error at once."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace
from typing import Any

import yaml

IDENTIFIER = re.compile(r"[A-Za-z0-9_]+\Z")
MAX_DEPTH = 10
TLS = ("disable", "preferred", "skip-verify", "required")


@dataclass
class StoreConfig:
    """Where tables are: a folder of the versioned store, or a JDBC server to load from."""

    path: str = ""
    job_schema: str = ""
    jdbc_host: str = ""
    port: int = 3306
    user: str = ""
    password: str = ""
    database: str = ""
    tls: str = "preferred"


@dataclass
class ServerConfig:
    host: str = ""
    port: int = 3306
    user: str = ""
    password: str = ""
    tls: str = "preferred"
    type: str = "async"
    channels: list[str] = field(default_factory=list)

    @property
    def address(self) -> str:
        return f"[{self.host}]:{self.port}" if ":" in self.host else f"{self.host}:{self.port}"


@dataclass
class ReplicationConfig:
    enabled: bool = False
    seconds_behind_source_within: float = 10
    check_interval: float = 5
    cache_ttl: float = 15
    servers: list[ServerConfig] = field(default_factory=list)


@dataclass
class Processing:
    batch_size: int = 1000
    batch_delete_size: int = 500
    sleep_seconds: float = 1
    delete_sleep_seconds: float = 0
    max_batch_bytes: int = 0  # 0: no limit
    sentinel_file: str = ""


@dataclass
class Verification:
    method: str = "count"
    skip_verification: bool = False


@dataclass
class Logging:
    level: str = "info"
    format: str = "json"
    output: str = "stdout"
    file_only: bool = False


@dataclass
class Relation:
    table: str = ""
    primary_key: str | None = ""
    foreign_key: str = ""
    dependency_type: str = ""
    relations: list[Relation] = field(default_factory=list)


@dataclass
class Job:
    root_table: str = ""
    primary_key: str = ""
    where: str = ""
    relations: list[Relation] = field(default_factory=list)
    processing: dict[str, Any] | None = None
    verification: dict[str, Any] | None = None
    logging: dict[str, Any] | None = None


@dataclass
class Config:
    source: StoreConfig = field(default_factory=StoreConfig)
    destination: StoreConfig = field(default_factory=StoreConfig)
    replication: ReplicationConfig = field(default_factory=ReplicationConfig)
    processing: Processing = field(default_factory=Processing)
    verification: Verification = field(default_factory=Verification)
    logging: Logging = field(default_factory=Logging)
    jobs: dict[str, Job] = field(default_factory=dict)
    catalog: dict[str, Any] = field(default_factory=dict)
    removed: list[str] = field(default_factory=list)  # keys of an older format that were given

    def job(self, name: str) -> Job:
        if name not in self.jobs:
            raise KeyError(f"job {name!r} not found in configuration")
        return self.jobs[name]

    # A field that a job does not set is inherited; one that it sets wins, 0 and false included.
    def job_processing(self, name: str) -> Processing:
        return replace(self.processing, **{k: v for k, v in (self.job(name).processing or {}).items() if v is not None})

    def job_verification(self, name: str) -> Verification:
        return replace(self.verification, **{k: v for k, v in (self.job(name).verification or {}).items() if v is not None and v != ""})

    def job_logging(self, name: str) -> Logging:
        own = self.job(name).logging
        if own is None:
            return self.logging
        kept = {k: v for k, v in own.items() if k != "file_only" and v}
        return replace(self.logging, **kept, file_only=bool(own.get("file_only", False)))

    def with_overrides(self, job: str | None = None, *, log_level: str = "", log_format: str = "", skip_verify: bool = False) -> Config:
        """Command-line flags win over jobs, jobs over the global blocks."""
        out = replace(self, logging=replace(self.logging, level=log_level or self.logging.level, format=log_format or self.logging.format), jobs=dict(self.jobs))
        for name, j in out.jobs.items():
            logging = j.logging and j.logging | ({"level": log_level} if log_level else {}) | ({"format": log_format} if log_format else {})
            verification = (j.verification or {}) | {"skip_verification": True} if skip_verify else j.verification
            out.jobs[name] = replace(j, logging=logging, verification=verification)
        if skip_verify:
            out.verification = replace(out.verification, skip_verification=True)
        return out


def _make(kind: type, given: dict | None) -> Any:
    given = given or {}
    names = {f.name for f in fields(kind)}
    unknown = sorted(given.keys() - names)
    if unknown:
        raise ValueError(f"unknown keys for {kind.__name__}: {', '.join(unknown)}")
    return kind(**{k: v for k, v in given.items() if v is not None or k == "primary_key"})


def _relation(given: dict) -> Relation:
    made = _make(Relation, {k: v for k, v in given.items() if k != "relations"})
    made.relations = [_relation(x) for x in given.get("relations") or []]
    return made


def parse(given: dict | None) -> Config:
    given = dict(given or {})
    removed = ["replica"] if given.pop("replica", None) else []
    safety = given.pop("safety", None) or {}
    removed += [f"safety.{k}" for k in ("lag_threshold", "check_interval") if safety.get(k)]
    replication = dict(given.get("replication") or {})
    servers = [_make(ServerConfig, x) for x in replication.pop("servers", None) or []]
    for s in servers:
        s.port, s.tls, s.type = s.port or 3306, s.tls or "preferred", s.type or "async"
    jobs = {}
    for name, j in (given.get("jobs") or {}).items():
        jobs[name] = _make(Job, {k: v for k, v in (j or {}).items() if k != "relations"})
        jobs[name].relations = [_relation(x) for x in (j or {}).get("relations") or []]
    made = _make(ReplicationConfig, replication)
    made.servers = servers
    return Config(
        source=_make(StoreConfig, given.get("source")), destination=_make(StoreConfig, given.get("destination")), replication=made,
        processing=_make(Processing, given.get("processing")), verification=_make(Verification, given.get("verification")), logging=_make(Logging, given.get("logging")),
        jobs=jobs, catalog=given.get("catalog") or {}, removed=removed,
    )


def load(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return parse(yaml.safe_load(f))


class ConfigError(ValueError):
    def __init__(self, errors: list[tuple[str, str]]):
        self.errors = errors
        super().__init__("validation failed:\n" + "\n".join(f"  - {f}: {m}" for f, m in errors))


def errors_of(c: Config) -> list[tuple[str, str]]:
    """(field, message) of everything that is wrong."""
    out: list[tuple[str, str]] = []

    def must(ok: bool, where: str, what: str) -> bool:
        if not ok:
            out.append((where, what))
        return ok

    def name(value: str | None, where: str, missing: str) -> None:
        if must(bool(value), where, missing):
            must(bool(IDENTIFIER.match(value)), where, "must contain only letters, digits and underscores")

    for side, store in (("source", c.source), ("destination", c.destination)):
        must(bool(store.path), f"{side}.path", "a path is required; tables of a server are loaded into a store first (sources.jdbc)")
        must(0 < store.port <= 65535, f"{side}.port", "not a TCP port (1 to 65535)")
        must(store.tls in (*TLS, ""), f"{side}.tls", f"tls must be one of {', '.join(TLS)}")
        if store.jdbc_host:
            must(bool(store.user), f"{side}.user", "user is required")
            must(bool(store.database), f"{side}.database", "database is required")
    if c.destination.job_schema:
        name(c.destination.job_schema, "destination.job_schema", "")
    r = c.replication
    must(not r.enabled or bool(r.servers), "replication.servers", "at least one server is required when replication is enabled")
    must(r.seconds_behind_source_within >= 0, "replication.seconds_behind_source_within", "cannot be negative")
    must(r.cache_ttl >= 0, "replication.cache_ttl", "cannot be negative")
    must(not r.enabled or r.check_interval > 0, "replication.check_interval", "must be positive when replication is enabled")
    seen: set[str] = set()
    for i, s in enumerate(r.servers):
        at = f"replication.servers[{i}]"
        must(bool(s.host), f"{at}.host", "host is required")
        must(not re.search(r"[\r\n]", s.host), f"{at}.host", "host must not hold a line break")
        must(bool(s.user), f"{at}.user", "user is required")
        must(1 <= s.port <= 65535, f"{at}.port", "not a TCP port (1 to 65535)")
        must(s.address not in seen, at, f"duplicate server {s.address!r}")
        seen.add(s.address)
        must(s.type == "async", f"{at}.type", f"unsupported type {s.type!r}; supported: async")
        must(s.tls in TLS, f"{at}.tls", f"tls must be one of {', '.join(TLS)}")
        for ch in {x for x in s.channels if s.channels.count(x) > 1}:
            out.append((f"{at}.channels", f"duplicate channel {ch or '<default>'!r}"))
    for key in c.removed:
        out.append((key, "was removed; use the replication block"))
    must(bool(c.jobs), "jobs", "there is no job")

    def relation(rel: Relation, at: str, depth: int) -> None:
        if depth > MAX_DEPTH:
            out.append((at, f"relations are nested deeper than {MAX_DEPTH}"))
            return
        name(rel.table, f"{at}.table", "table is required")
        name(rel.foreign_key, f"{at}.foreign_key", "foreign_key is required")
        # a leaf may state that it has no key; it is then selected by its foreign key
        if not (rel.primary_key is None and not rel.relations):
            name(rel.primary_key, f"{at}.primary_key", "primary_key is required")
        must(rel.dependency_type in ("1-1", "1-N", ""), f"{at}.dependency_type", "must be '1-1' or '1-N'")
        for i, x in enumerate(rel.relations):
            relation(x, f"{at}.relations[{i}]", depth + 1)

    def processing(p: Processing, at: str) -> None:
        must(p.batch_size > 0, f"{at}.batch_size", "must be positive")
        must(p.batch_delete_size > 0, f"{at}.batch_delete_size", "must be positive")
        must(p.sleep_seconds >= 0, f"{at}.sleep_seconds", "cannot be negative")
        must(p.delete_sleep_seconds >= 0, f"{at}.delete_sleep_seconds", "cannot be negative")
        must(p.max_batch_bytes >= 0, f"{at}.max_batch_bytes", "cannot be negative")

    def logging(x: Logging, at: str) -> None:
        must(x.level in ("debug", "info", "warn", "error", ""), f"{at}.level", "must be 'debug', 'info', 'warn' or 'error'")
        must(x.format in ("json", "text", ""), f"{at}.format", "must be 'json' or 'text'")
        must(not (x.file_only and x.output in ("", "stdout", "stderr")), f"{at}.file_only", "requires output to be a file")

    for n, j in c.jobs.items():
        at = f"jobs.{n}"
        name(j.root_table, f"{at}.root_table", "root_table is required")
        name(j.primary_key, f"{at}.primary_key", "primary_key is required")
        must(bool((j.where or "").strip()), f"{at}.where", "where is required; use 1=1 for the whole table")
        for i, x in enumerate(j.relations):
            relation(x, f"{at}.relations[{i}]", 1)
        if j.processing is not None:
            processing(c.job_processing(n), f"{at}.processing")
        if j.verification is not None:
            must(c.job_verification(n).method in ("count", "sha256"), f"{at}.verification.method", "must be 'count' or 'sha256'")
        if j.logging is not None:
            logging(c.job_logging(n), f"{at}.logging")
    processing(c.processing, "processing")
    must(c.verification.method in ("count", "sha256"), "verification.method", "must be 'count' or 'sha256'")
    logging(c.logging, "logging")
    return out


def validate(c: Config) -> None:
    if found := errors_of(c):
        raise ConfigError(found)
