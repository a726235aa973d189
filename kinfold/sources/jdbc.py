"""Loading tables from a MySQL-compatible server through Spark's JDBC source, where a driver is at hand."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinfold.config import StoreConfig

_TLS = {"disable": {"sslMode": "DISABLED"}, "preferred": {"sslMode": "PREFERRED"}, "skip-verify": {"sslMode": "REQUIRED"}, "required": {"sslMode": "VERIFY_CA"}, "": {"sslMode": "PREFERRED"}}


def options(c: StoreConfig) -> dict[str, str]:
    """Options of spark.read.format("jdbc"). An unknown TLS mode is refused rather than left unencrypted."""
    if c.tls not in _TLS:
        raise ValueError(f"unsupported tls value {c.tls!r}")
    extra = _TLS[c.tls] | {"connectionTimeZone": "UTC"}
    url = f"jdbc:mysql://{c.jdbc_host}:{c.port}/{c.database}?" + "&".join(f"{k}={v}" for k, v in extra.items())
    return {"url": url, "user": c.user, "password": c.password, "driver": "com.mysql.cj.jdbc.Driver"}


def with_retry(connect: Callable[[], DataFrame], attempts: int = 3, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Try again after 1, 2, ... seconds; the last error is raised."""
    for k in range(attempts):
        try:
            return connect()
        except Exception:
            if k == attempts - 1:
                raise
            sleep(pause * 2**k)
    raise AssertionError


def table(spark: SparkSession, c: StoreConfig, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16) -> DataFrame:
    """A table of the server; with a numeric key and its bounds it is read in several partitions."""
    opts = options(c) | {"dbtable": f"`{name}`"}
    if key and bounds:
        opts |= {"partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return with_retry(lambda: spark.read.format("jdbc").options(**opts).load())
