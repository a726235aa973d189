"""Locks, the pause switch, graceful stops and the health gate."""

from __future__ import annotations

import fcntl
import os
import signal
import threading
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from kinfold.config import ReplicationConfig, ServerConfig
from kinfold.functions.predicates import one_line, safe_name


class LockError(RuntimeError):
    pass


class StopRequested(RuntimeError):
    pass


class FileLock:
    """An exclusive lock that ends with its process. The file names its owner."""

    def __init__(self, folder: str, name: str, owner: str | None = None):
        self.path, self.owner, self._file = os.path.join(folder, f"{safe_name(name)}.lock"), owner or f"pid {os.getpid()}", None

    def acquire(self, wait: float = 0) -> bool:
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        handle, until = open(self.path, "a+"), time.monotonic() + wait
        while True:
            try:
                fcntl.flock(handle, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except OSError:
                if time.monotonic() >= until:
                    handle.close()
                    return False
                time.sleep(0.05)
        handle.truncate(0)
        handle.write(self.owner)
        handle.flush()
        self._file = handle
        return True

    def held(self) -> bool:
        """Whether this object still owns the lock: the file is there and names it."""
        if self._file is None:
            return False
        try:
            return os.path.samestat(os.fstat(self._file.fileno()), os.stat(self.path)) and open(self.path).read() == self.owner
        except OSError:
            return False

    def release(self) -> None:
        if self._file is not None:
            fcntl.flock(self._file, fcntl.LOCK_UN)
            self._file.close()
            self._file = None


def may_force(kind: str, lock_held: bool, heartbeat_stale: bool, force: bool) -> bool:
    """Force never passes a live heartbeat, and never a held lock of a job that deletes."""
    if not lock_held and heartbeat_stale:
        return True
    if not force or not heartbeat_stale:
        return False
    return not (lock_held and kind in ("archive", "purge"))


@dataclass
class Keepalive:
    """Calls beat every interval seconds in the background; after three failures in a row on_lost is called once."""

    beat: Callable[[], None]
    interval: float
    on_lost: Callable[[Exception], None]
    failures: int = 3
    _stop: threading.Event = field(default_factory=threading.Event)

    def start(self) -> Keepalive:
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()
        return self

    def _run(self) -> None:
        bad = 0
        while not self._stop.wait(self.interval):
            try:
                self.beat()
                bad = 0
            except Exception as e:  # noqa: BLE001
                bad += 1
                if bad >= self.failures:
                    self.on_lost(e)
                    return

    def stop(self) -> None:
        self._stop.set()
        self._thread.join(timeout=5)


@dataclass
class Stop:
    """The first signal asks for a stop at the next batch; the second one cancels."""

    requested: threading.Event = field(default_factory=threading.Event)
    cancelled: threading.Event = field(default_factory=threading.Event)

    def install(self) -> Stop:
        for s in (signal.SIGINT, signal.SIGTERM):
            signal.signal(s, lambda *_: self.signal())
        return self

    def signal(self) -> None:
        (self.cancelled if self.requested.is_set() else self.requested).set()
        if self.cancelled.is_set():
            raise KeyboardInterrupt


def wait_for_sentinel(path: str, stop: Stop | None = None, poll: float = 1.0) -> bool:
    """Hold while the file exists. False if a stop was asked for meanwhile."""
    while path and os.path.exists(path):
        if stop and stop.requested.wait(poll):
            return False
        if not stop:
            time.sleep(poll)
    return not (stop and stop.requested.is_set())


# -- health of replicas ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Channel:
    name: str
    running: bool
    lag_seconds: float | None


def problem_of(server: ServerConfig, channels: Iterable[Channel] | None, tolerance: float) -> str | None:
    """The first that applies: unreadable, channels missing, none configured, not running, lag unknown or too large."""
    if channels is None:
        return f"{server.address}: unreachable or unreadable"
    have = {c.name: c for c in channels}
    show = lambda names: ", ".join(n or "<default>" for n in names)
    if missing := [n for n in server.channels if n not in have]:
        return f"{server.address}: channels missing: {show(missing)}"
    own = [have[n] for n in server.channels] if server.channels else list(have.values())
    if not own:
        return f"{server.address}: replication is not configured"
    if off := [c.name for c in own if not c.running]:
        return f"{server.address}: not running: {show(off)}"
    if late := [c.name for c in own if c.lag_seconds is None or c.lag_seconds > tolerance]:
        return f"{server.address}: behind: {show(late)}"
    return None


class HealthGate:
    """Holds a job while any server has a problem. A pass stays good for cache_ttl seconds; a failure never does."""

    def __init__(self, config: ReplicationConfig, read: Callable[[ServerConfig], Iterable[Channel]], clock=time.monotonic, sleep=time.sleep, log: Callable[[str], None] = lambda _: None):
        self.config, self.read, self.clock, self.sleep, self.log, self._passed = config, read, clock, sleep, log, None

    def problems(self) -> list[str]:
        out = []
        for s in self.config.servers:
            try:
                found = list(self.read(s))
            except Exception as e:  # noqa: BLE001  whatever fails is a problem of that server
                self.log(one_line(f"{s.address}: {e}"))
                found = None
            if p := problem_of(s, found, self.config.seconds_behind_source_within):
                out.append(one_line(p))
        return out

    def wait(self, stop: Stop | None = None) -> None:
        if not self.config.enabled:
            return
        if self._passed is not None and self.config.cache_ttl > 0 and self.clock() - self._passed < self.config.cache_ttl:
            return
        while found := self.problems():
            self.log("held: " + "; ".join(found))
            if stop and stop.requested.is_set():
                raise StopRequested("stopped while held by the health gate")
            self.sleep(self.config.check_interval)
        self._passed = self.clock()
