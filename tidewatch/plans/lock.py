"""One run of a command at a time on a machine."""

from __future__ import annotations

import contextlib
import fcntl
import os
import time
from collections.abc import Iterator

#: Exit status of a run that found the lock held: try again later.
EX_TEMPFAIL = 75


class Held(RuntimeError):
    """Another run holds the lock."""


@contextlib.contextmanager
def single_instance(name: str, folder: str, wait_secs: float = 0, poll_secs: float = 1.0) -> Iterator[None]:
    """Holds the lock of `name`; waits up to `wait_secs` for another run, then raises Held with its pid and age.

    The lock is the kernel's, so it ends with the process; the file stays.
    """
    os.makedirs(folder, exist_ok=True)
    fd = os.open(os.path.join(folder, f"{name}.lock"), os.O_RDWR | os.O_CREAT, 0o644)
    try:
        until = time.monotonic() + wait_secs
        while True:
            try:
                fcntl.flock(fd, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except BlockingIOError:
                if time.monotonic() >= until:
                    pid, _, since = os.pread(fd, 200, 0).decode(errors="replace").partition(" ")
                    age = int(time.time() - float(since)) if since.strip().replace(".", "").isdigit() else "?"
                    raise Held(f"{name} is running: pid {pid or '?'}, for {age} s") from None
                time.sleep(min(poll_secs, max(0.0, until - time.monotonic())))
        os.ftruncate(fd, 0)
        os.pwrite(fd, f"{os.getpid()} {time.time():.0f}".encode(), 0)
        yield
    finally:
        os.close(fd)
