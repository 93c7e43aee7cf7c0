"""One run of a command at a time across machines: a lease in shared storage, with a number that fences off who lost it.

A lease is a file named by its number; who creates the file of the next number, which the file system lets one do, holds
it. The holder tells in a file beside it until when it holds, and tells again while it lives. A lease that was not
renewed is free, and the next holder's higher number makes every write of the last one fail, however late it comes.
"""

from __future__ import annotations

import contextlib
import threading
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession

from .lock import Held


class Lost(RuntimeError):
    """Another run holds the lease now."""


class Lease:
    def __init__(self, spark: SparkSession, folder: str, name: str, ttl_secs: float, clock: Callable[[], float] = time.time):
        self.path, self.ttl, self.clock, self.number = f"{folder.rstrip('/')}/{name}", ttl_secs, clock, 0
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop(f"{self.path}/{name}")

    def newest(self) -> int:
        if not self._fs.exists(self._hadoop(self.path)):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop(self.path))]
        return max((int(n[1:]) for n in names if n[:1] == "n" and n[1:].isdigit()), default=0)

    def _until(self, number: int) -> float:
        """When a lease ends: as its holder says, or, if it hasn't yet, a term after it was taken."""
        beat = self._at(f"until{number}")
        if self._fs.exists(beat):
            stream = self._fs.open(beat)
            try:
                return float(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
        return self._fs.getFileStatus(self._at(f"n{number}")).getModificationTime() / 1000 + self.ttl

    def _say(self, until: float) -> None:
        tmp = self._at(f"tmp-{uuid.uuid4().hex}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(repr(until).encode()))
        out.close()
        target = self._at(f"until{self.number}")
        if not self._fs.rename(tmp, target):  # a file system that doesn't rename over a file
            self._fs.delete(target, False)
            self._fs.rename(tmp, target)

    def acquire(self) -> None:
        """Takes the lease, or raises Held."""
        last = self.newest()
        if last and self._until(last) > self.clock():
            raise Held(f"{self.path} is held by number {last}")
        try:
            self._fs.create(self._at(f"n{last + 1}"), False).close()
        except Exception as e:  # noqa: BLE001  whatever the file system says of a file that exists
            raise Held(f"{self.path} was taken just now") from e
        self.number = last + 1
        self.renew()
        for name in (f"n{last - 1}", f"until{last - 1}"):  # the last one's stay, for those that hold it still
            self._fs.delete(self._at(name), False)

    def check(self) -> None:
        """Raises Lost unless this is the newest lease."""
        if not self.number or self.newest() != self.number:
            raise Lost(f"{self.path}: number {self.number} is not the newest")

    def renew(self) -> None:
        self.check()
        self._say(self.clock() + self.ttl)

    def release(self) -> None:
        if self.number and self.newest() == self.number:
            self._say(0.0)


@contextlib.contextmanager
def hold(spark: SparkSession, folder: str, name: str, ttl_secs: float = 60.0) -> Iterator[Lease]:
    """Holds a lease and renews it three times a term."""
    lease, done = Lease(spark, folder, name, ttl_secs), threading.Event()
    lease.acquire()

    def beat() -> None:
        while not done.wait(ttl_secs / 3):
            try:
                lease.renew()
            except Lost:
                return  # the next write says so
            except Exception:  # noqa: BLE001, S112  storage out of reach: tried again until the term ends
                continue

    thread = threading.Thread(target=beat, daemon=True)
    thread.start()
    try:
        yield lease
    finally:
        done.set()
        thread.join()
        lease.release()
