"""Calls within a rate, by a clock of their own and by the real one; refused calls."""

import os
import time

import pytest

import docweave as dw
from docweave.operators.throttle import Pace, RateLimit, RateLimited, paced
from test_document import run


class Clock:
    def __init__(self):
        self.at = 100.0

    def now(self):
        return self.at

    def sleep(self, seconds):
        assert seconds > 0
        self.at += seconds


def in_any_minute(calls):
    """The most that falls into a minute: (time, amount)."""
    return max((sum(n for at, n in calls if start <= at < start + 60 - 1e-6) for start, _ in calls), default=0)


def answer_of(request):
    return {"key": request["key"], "error": None, "status": "ok"}


@pytest.mark.parametrize("tasks", [1, 4])
def test_no_minute_has_more_calls_than_the_limit(tasks):
    limit = RateLimit(calls_per_minute=20)
    calls = []
    for _ in range(tasks):
        clock = Clock()
        for turn in range(3):  # tasks that follow each other in one slot
            pace = Pace(limit, tasks, clock.now, clock.sleep)
            requests = [{"key": i} for i in range(7)]
            made = paced(requests, lambda r: calls.append((clock.at, 1)) or answer_of(r), lambda _: None, limit, pace)
            assert [a["key"] for a in made] == list(range(7))
    assert len(calls) == 21 * tasks and in_any_minute(calls) <= 20


def test_tokens_are_counted():
    limit = RateLimit(calls_per_minute=1000, tokens_per_minute=600)
    clock, calls = Clock(), []
    pace = Pace(limit, 1, clock.now, clock.sleep)
    sizes = [100, 300, 50, 900, 10, 10, 400, 200] * 3
    rows = [{"key": i, "tokens": n} for i, n in enumerate(sizes)]
    list(paced(rows, lambda r: calls.append((clock.at, r["tokens"])) or answer_of(r), lambda _: None, limit, pace))
    # One request may begin before the minute.
    assert in_any_minute(calls) <= 600 + max(sizes) and calls[-1][0] - 100 >= sum(sizes) / 10


def test_refused_calls_come_back_later_and_later_and_are_given_up():
    limit = RateLimit(calls_per_minute=6000, attempts=4, first_delay=2, longest_delay=5)
    clock, calls, refusals = Clock(), [], {1: 2, 2: 99, 5: 1}
    pace = Pace(limit, 1, clock.now, clock.sleep)

    def call(request):
        key = request["key"]
        calls.append((key, clock.at))
        if refusals.get(key, 0) > 0:
            refusals[key] -= 1
            return {"key": key, "error": "no", "status": "rate_limited", "retry_after": 7 if key == 5 else 0}
        return answer_of(request)

    made = list(paced([{"key": i} for i in range(8)], call, lambda a: a.get("retry_after"), limit, pace))
    assert [a["key"] for a in made[:5]] == [0, 3, 4, 6, 7]  # others go on meanwhile
    given_up = [a for a in made if a["status"] != "ok"]
    assert [(a["key"], a["error"]) for a in given_up] == [(2, "no (given up after 4 attempts)")]
    times = {key: [at for k, at in calls if k == key] for key in (1, 2, 5)}
    gaps = [b - a for a, b in zip(times[2], times[2][1:])]
    assert len(times[1]) == 3 and len(gaps) == 3 and 2 <= gaps[0] <= 3.1 and 4 <= gaps[1] <= 6.1 and 5 <= gaps[2] <= 7.6
    assert times[5][1] - times[5][0] >= 7


def test_many_refused_calls_are_not_held(monkeypatch):
    monkeypatch.setattr("docweave.operators.throttle.HELD_CALLS", 5)
    limit = RateLimit(calls_per_minute=60_000, attempts=2, first_delay=1, longest_delay=1)
    clock, calls = Clock(), []
    pace = Pace(limit, 1, clock.now, clock.sleep)

    def call(request):
        calls.append(request["key"])
        return {"key": request["key"], "error": "no", "status": "rate_limited", "retry_after": 0.0}

    made = list(paced([{"key": i} for i in range(100)], call, lambda a: a.get("retry_after"), limit, pace))
    assert len(made) == 100 and len(calls) == 200
    assert max(sum(calls[:i].count(k) == 1 for k in set(calls[:i])) for i in range(0, 200, 9)) <= 7


def timing(folder):
    def generate(language, definition, definition_type, temperature):
        name = f"{time.time():.6f}"
        open(os.path.join(folder, name), "x").close()
        if "always" in definition:
            raise RateLimited("never")
        if "once" in definition and len([n for n in os.listdir(folder) if n.startswith("once")]) == 0:
            open(os.path.join(folder, "once"), "x").close()
            raise RateLimited("not now", retry_after=0.2)
        return {"description": "works."}

    return generate


def test_a_job_keeps_to_its_rate(spark, tmp_path):
    modules = {f"m{i}.py": f"def f{i}(): pass\n" for i in range(10)}
    modules |= {"once.py": "def once(): pass\n", "always.py": "def always(): pass\n"}
    limit = dw.RateLimit(calls_per_minute=240, attempts=3, first_delay=0.1)
    done = run(spark, modules, timing(str(tmp_path)), rate_limit=limit, max_workers=2)
    status = {r.d.name: (r.status, r.error) for r in done.docstrings().collect()}
    assert status["always"][0] == "rate_limited" and "given up after 3 attempts" in status["always"][1]
    assert {s for name, (s, _) in status.items() if name != "always"} == {"ok"}
    times = sorted(float(n) for n in os.listdir(tmp_path) if n != "once")
    assert len(times) == 15
    # Each of two tasks keeps half a second between its calls: three calls of both take that at least.
    assert min(c - a for a, c in zip(times, times[2:])) > 0.45
    with pytest.raises(TypeError):
        dw.DocumentationConfig(generate_docstring_func=print, rate_limit=5)
    with pytest.raises(ValueError):
        dw.RateLimit(calls_per_minute=0)
