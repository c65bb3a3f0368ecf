"""Rate limits and outage handling of remote hosts. Driver-side state machines; time is passed in for tests."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pelorus.functions.numbers import normal_rate

#: Statuses that mean the host is out of service for now.
OUTAGE_STATUSES = (429, 502, 503, 504)


class RateLimiter:
    """At most ``rate`` starts per ``period`` seconds, evenly spaced; it limits starts, not how many run at once."""

    def __init__(self, rate: float, period: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        rate, period = normal_rate(rate, period)
        self.spacing, self._clock, self._sleep = period / rate, clock, sleep
        self._lock, self._next = threading.Lock(), 0.0

    def acquire(self) -> None:
        with self._lock:
            now = self._clock()
            at = max(now, self._next)
            self._next = at + self.spacing
        if at > now:
            self._sleep(at - now)


def is_outage(status: int | None) -> bool:
    """No answer at all, or a status that asks to come back later."""
    return status is None or status in OUTAGE_STATUSES


class GaveUp(Exception):
    """A host's outage lasts longer than allowed."""


@dataclass
class _Host:
    next_start: float = 0.0
    step: int = 0
    epoch: int = 0
    since: float | None = None
    until: float = 0.0
    lock: threading.Lock = field(default_factory=threading.Lock)


class HostCoordinator:
    """Spaces the calls to each host and, during an outage, backs off exponentially.

    A worker takes an epoch with :meth:`ready` and reports with it; reports of an older epoch don't lengthen the
    outage again, and epochs only rise. ``max_outage`` seconds after its start an outage raises :class:`GaveUp`.
    """

    def __init__(
        self, spacing: float = 0.0, base: float = 60.0, ceiling: float = 3840.0, max_outage: float = 86400.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep
    ) -> None:
        self.spacing, self.base, self.ceiling, self.max_outage, self._clock, self._sleep = spacing, base, ceiling, max_outage, clock, sleep
        self._hosts: dict[str, _Host] = {}
        self._lock = threading.Lock()

    def _of(self, host: str) -> _Host:
        with self._lock:
            return self._hosts.setdefault(host, _Host())

    def delay(self, step: int) -> float:
        return min(self.base * 2**step, self.ceiling)

    def ready(self, host: str) -> int:
        """Wait for the host's turn; return the epoch."""
        h = self._of(host)
        with h.lock:
            now = self._clock()
            if h.since is not None and now - h.since > self.max_outage:
                raise GaveUp(host)
            at = max(now, h.next_start, h.until)
            h.next_start = at + self.spacing
            epoch = h.epoch
        if at > now:
            self._sleep(at - now)
        return epoch

    def report(self, host: str, epoch: int, status: int | None) -> bool:
        """Take note of an answer; True if it means an outage and the call should come again."""
        h = self._of(host)
        with h.lock:
            if not is_outage(status):
                if h.since is not None:
                    h.since, h.step, h.until = None, 0, 0.0
                    h.epoch += 1
                return False
            now = self._clock()
            if epoch == h.epoch:
                h.since = now if h.since is None else h.since
                h.until = now + self.delay(h.step)
                h.step += 1
                h.epoch += 1
            return True
