"""Calls within a rate, and calls that a service refuses for the rate tried again.

Each of the tasks that call the generator gets an equal share of the job's limit and keeps its calls apart:
before a call it waits for what that call costs at its share, counted from its call before (or from its
start, so that tasks which follow each other in one slot keep apart too). In no minute do the tasks together
make more calls than the limit, nor send more tokens than the limit and one request of each task.
A task that is repeated after a loss makes its calls again, at the same pace.

A refused call waits in a queue, with a delay that doubles from one refusal to the next, while others go
on; after ``attempts`` refusals it is given up.
"""

from __future__ import annotations

import heapq
import random
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

RATE_LIMIT_CODE = "rate_limit_exceeded"
#: Refused calls that a task holds; beyond it they come before new ones.
HELD_CALLS = 1000


class RateLimited(Exception):
    """Raise this from a generator when its service refuses a call for the rate (or any error with this
    ``code``); ``retry_after`` seconds, if known, are waited at least."""

    code = RATE_LIMIT_CODE

    def __init__(self, message: str = "", retry_after: float = 0.0) -> None:
        super().__init__(message)
        self.retry_after = retry_after


@dataclass(frozen=True)
class RateLimit:
    """What a whole job may call and send in a minute, and how often a refused call is tried."""

    calls_per_minute: float
    tokens_per_minute: float | None = None
    attempts: int = 6
    first_delay: float = 1.0
    longest_delay: float = 120.0

    def __post_init__(self) -> None:
        if self.calls_per_minute <= 0 or (self.tokens_per_minute is not None and self.tokens_per_minute <= 0):
            raise ValueError("rates must be positive")
        if self.attempts < 1 or self.first_delay < 0 or self.longest_delay < self.first_delay:
            raise ValueError("attempts and delays must be positive, the longest delay not below the first")


class Pace:
    """Keeps the calls of one of ``tasks`` tasks apart."""

    def __init__(self, limit: RateLimit, tasks: int, now: Callable = time.monotonic, sleep: Callable = time.sleep):
        self.per_call = 60.0 * tasks / limit.calls_per_minute
        self.per_token = 60.0 * tasks / limit.tokens_per_minute if limit.tokens_per_minute else 0.0
        self.now, self.sleep = now, sleep
        self.last = now()

    def wait(self, tokens: int) -> None:
        at = self.last + max(self.per_call, self.per_token * tokens)
        while (left := at - self.now()) > 0:
            self.sleep(left)
        self.last = self.now()


def paced(
    requests: Iterable[dict],
    call: Callable[[dict], dict],
    refused: Callable[[dict], float | None],
    limit: RateLimit,
    pace: Pace,
) -> Iterator[dict]:
    """The answers, in the order in which they are there. ``refused`` tells of an answer whether the
    service refused the call (None: no), and the least seconds to wait then."""
    waiting: list[tuple[float, int, int, dict]] = []
    spread = random.Random(pace.now())
    count = 0

    def attempt(request: dict, number: int) -> Iterator[dict]:
        nonlocal count
        pace.wait(request.get("tokens") or 0)
        answer = call(request)
        least = refused(answer)
        if least is None or number >= limit.attempts:
            if least is not None:
                answer["error"] = f"{answer['error']} (given up after {number} attempts)"
            yield answer
            return
        delay = min(limit.longest_delay, limit.first_delay * 2 ** (number - 1))
        # Up to a half more, so that calls refused together do not come back together.
        ready = pace.now() + max(least, delay * (1 + spread.random() / 2))
        count += 1
        heapq.heappush(waiting, (ready, count, number + 1, request))

    def again(hold: int) -> Iterator[dict]:
        """Calls whose delay is over; while more than ``hold`` wait, also the next ones."""
        while waiting and (len(waiting) > hold or waiting[0][0] <= pace.now()):
            ready, _, number, request = heapq.heappop(waiting)
            while (left := ready - pace.now()) > 0:
                pace.sleep(left)
            yield from attempt(request, number)

    for one in requests:
        yield from attempt(one, 1)
        yield from again(HELD_CALLS)
    yield from again(0)
