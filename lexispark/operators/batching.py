"""Rows to requests: batches, concurrent rounds and back-off. Free of Spark, so it is tested alone."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from itertools import islice
from typing import Any

#: Requests of one task that are in flight together.
CONCURRENCY = 16
AGGREGATE_BACK_OFF = 0.9


class TokenOverflow(Exception):
    """A request, or its answer, is longer than the model takes."""


class UsageExceeded(Exception):
    """A usage limit is reached: the request was not sent."""


#: Answers rows [start, stop).
Call = Callable[[int, int], list[Any]]


def fitted(answers: list[Any], n: int) -> list[Any]:
    """Exactly n answers: missing ones are null, surplus ones go."""
    return [*answers[:n], *[None] * (n - len(answers))]


def in_turn(n: int, size: int, call: Call) -> list[Any]:
    """One request after the other. An overflow halves the batch, down to a null for a single row; a success
    restores its size. Once a usage limit is reached, the rows left are null."""
    out: list[Any] = []
    now = size
    while len(out) < n:
        step = min(now, n - len(out))
        try:
            out += fitted(call(len(out), len(out) + step), step)
            now = size
        except TokenOverflow:
            now = step // 2
            if now == 0:
                out.append(None)
                now = size
        except UsageExceeded:
            return fitted(out, n)
    return out


def in_rounds(n: int, size: int, call: Call, exceeded: Callable[[], bool] = lambda: False, workers: int = CONCURRENCY) -> list[Any]:
    """All batches at once. Batches that overflow are halved and sent again in the next round, down to a null for
    a single row. Where a usage limit is reached before a round, its rows are null; what is in flight returns."""
    out: list[Any] = [None] * n
    batches = [(i, min(i + size, n)) for i in range(0, n, size)]

    def one(batch: tuple[int, int]) -> list[Any] | None:
        try:
            return fitted(call(*batch), batch[1] - batch[0])
        except TokenOverflow:
            return None

    with ThreadPoolExecutor(max(1, min(workers, len(batches)))) as pool:
        while batches and not exceeded():
            again = []
            for (start, stop), answers in zip(batches, pool.map(one, batches), strict=True):
                if answers is not None:
                    out[start:stop] = answers
                elif stop - start > 1:
                    middle = start + (stop - start) // 2
                    again += [(start, middle), (middle, stop)]
            batches = again
    return out


def shrunk(size: int) -> int:
    """The batch size after an overflow in an aggregate."""
    size = int(size * AGGREGATE_BACK_OFF)
    if size == 0:
        raise ValueError("Batch size reduced to zero, unable to process tuples")
    return size


def fold(rows: Iterable[Any], size: int, ask: Callable[[list[Any], str | None], Any]) -> Any:
    """Reduces rows batch by batch, each request given the summary so far. Rows are taken as they are asked about: one
    batch is held, whatever their number."""
    rows, waiting, summary = iter(rows), [], None
    while waiting := waiting + list(islice(rows, max(0, size - len(waiting)))):
        batch = waiting[:size]
        try:
            summary = ask(batch, summary)
        except TokenOverflow:
            size = shrunk(min(size, len(batch)))
            continue
        waiting = waiting[len(batch) :]
    return summary


def row_id(answer: Any, allowed: list[int]) -> int:
    """An answered row id, checked against the window's."""
    try:
        found = answer if isinstance(answer, int) and not isinstance(answer, bool) else int(str(answer).strip())
    except ValueError:
        raise ValueError(f"the model answered {answer!r}, which is no row id") from None
    if found not in allowed:
        raise ValueError(f"the model answered row id {found}, which is not among the window's")
    return found


def tournament(n: int, size: int, ask: Callable[[list[int]], Any]) -> int:
    """The row that wins against all others, window by window; the winner so far joins the next window.

    A window compares at least two rows, also at a batch size of 1; where the model overflows on two, an error is raised.
    """
    winner, at = None, 0
    while at < n:
        fresh = list(range(at, min(at + (size if winner is not None else max(size, 2)), n)))
        window = fresh if winner is None else [winner, *fresh]
        if n == 1:
            return 0
        try:
            found = row_id(ask(window), window)
        except TokenOverflow:
            size = shrunk(min(size, len(fresh)))
            continue
        winner, at = found, at + len(fresh)
    assert winner is not None
    return winner


def ranked(answered: list[Any], window: list[int]) -> list[int]:
    """A window's rows as the model ranked them; those that it left out come last."""
    out: list[int] = []
    for a in answered:
        found = row_id(a, window)
        if found in out:
            raise ValueError(f"the model ranked row id {found} twice")
        out.append(found)
    return out + [i for i in window if i not in out]


def one_pass(rows: list[int], size: int, ask: Callable[[list[int]], list[Any]]) -> tuple[list[int], list[list[int]]]:
    """(rows ranked in place by windows from the list's end to its beginning, the parts that were settled in turn).

    The better half of a window is compared again, with the rows before it; the rest is settled. The best size // 2 rows
    come first in their order, whatever the list. Rows stay in place on an overflow, so none is lost; a window has two at least.
    """
    rows, end, size = list(rows), len(rows), max(2, size)
    settled: list[list[int]] = []
    while end > 0:
        start = max(0, end - size)
        window = rows[start:end]
        if len(window) > 1:
            try:
                rows[start:end] = ranked(ask(window), window)
            except TokenOverflow:
                size = shrunk(min(size, len(window)))
                if size < 2:
                    shrunk(0)
                continue
        upto = start + len(window) // 2 if start else 0
        settled.append(rows[upto:end] if start else rows[len(window) // 2 : end])
        if not start and len(window) // 2:
            settled.append(rows[: len(window) // 2])
        end = upto
    return rows, settled


def rerank(n: int, size: int, ask: Callable[[list[int]], list[Any]], order: str = "relevance", passes: int = 1) -> list[int]:
    """All rows by relevance, the best first, after so many passes of sliding windows (0: until a pass moves nothing, which
    is the model's full order if it is consistent). order="window": in the order in which the last pass settles them."""
    rows, parts, done = list(range(n)), [list(range(n))], 0
    while n > 1 and (done < passes or not passes):
        before = rows
        rows, parts = one_pass(rows, size, ask)
        done += 1
        if rows == before:
            break
    return rows if order == "relevance" else [i for part in parts for i in part]
