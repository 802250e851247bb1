import random

import pytest

from lexispark.operators import batching as b


def recorder(fail=lambda k, n: False):
    sizes = []

    def call(start, stop):
        sizes.append(stop - start)
        if fail(len(sizes), stop - start):
            raise b.TokenOverflow
        return list(range(start, stop))

    return call, sizes


def test_batches_and_order():
    for run in (b.in_turn, b.in_rounds):
        call, sizes = recorder()
        assert run(100, 16, call) == list(range(100)) and sorted(sizes) == [4] + [16] * 6
        call, sizes = recorder()
        assert run(17, 16, call) == list(range(17)) and sorted(sizes) == [1, 16]
        assert run(0, 16, call) == []


def test_rounds_halve_what_failed():
    call, sizes = recorder(lambda k, n: n > 8 or n == 4)
    assert b.in_rounds(100, 16, call, workers=1) == list(range(100))
    assert sizes[7:] == [8] * 12 + [2, 2]
    call, sizes = recorder(lambda k, n: k == 2)
    assert b.in_rounds(4, 2, call, workers=1) == [0, 1, 2, 3] and sizes == [2, 2, 1, 1]


def test_turns_halve_and_recover():
    call, sizes = recorder(lambda k, n: k <= 2)
    assert b.in_turn(3, 1, call) == [None, None, 2]
    call, sizes = recorder(lambda k, n: k == 1)
    assert b.in_turn(40, 16, call) == list(range(40)) and sizes == [16, 8, 16, 16]
    call, _ = recorder(lambda k, n: True)
    assert b.in_turn(5, 4, call) == [None] * 5
    assert b.in_rounds(5, 4, call) == [None] * 5


def test_usage_limits():
    calls = []

    def call(start, stop):
        if len(calls) == 2:
            raise b.UsageExceeded
        calls.append(start)
        return ["ok"]

    assert b.in_turn(3, 1, call) == ["ok", "ok", None]
    assert b.in_rounds(4, 2, lambda s, e: [1] * (e - s), lambda: True) == [None] * 4


def test_short_and_long_answers():
    assert b.in_turn(4, 4, lambda s, e: [1, 2]) == [1, 2, None, None]
    assert b.in_rounds(2, 4, lambda s, e: [1, 2, 3]) == [1, 2]


def test_fold():
    asked = []

    def ask(batch, summary):
        asked.append((len(batch), summary))
        if len(batch) > 9:
            raise b.TokenOverflow
        return (summary or 0) + len(batch)

    assert b.fold(list(range(20)), 10, ask) == 20 and asked == [(10, None), (9, None), (9, 9), (2, 18)]
    assert b.fold([1], 16, lambda batch, s: "one") == "one" and b.fold([], 4, ask) is None

    def never(batch, summary):
        raise b.TokenOverflow

    with pytest.raises(ValueError, match="Batch size reduced to zero"):
        b.fold([1, 2], 2, never)


def test_fold_holds_one_batch():
    taken = []

    def rows():
        for i in range(100):
            taken.append(i)
            yield i

    def ask(batch, summary):
        assert len(taken) - (summary or 0) <= 8 + 1  # asked about, or refused before
        if len(batch) > 6:
            raise b.TokenOverflow
        assert batch == list(range(summary or 0, (summary or 0) + len(batch)))
        return (summary or 0) + len(batch)

    assert b.fold(rows(), 8, ask) == 100


def test_tournament():
    windows = []

    def ask(window):
        windows.append(list(window))
        return str(max(window))

    assert b.tournament(40, 16, ask) == 39 and [len(w) for w in windows] == [16, 17, 9] and windows[1][0] == 15
    assert b.tournament(1, 16, None) == 0
    for wrong in ("x", 99, None, 1.5j):
        with pytest.raises(ValueError):
            b.tournament(3, 2, lambda w, wrong=wrong: wrong)


def test_small_windows_still_compare():
    """At a batch size of 1, and after overflows, windows hold two rows, and two that overflow are an error."""
    for n in (2, 5, 40):
        for size in (1, 2, 3):
            assert b.tournament(n, size, max) == n - 1
            assert sorted(b.rerank(n, size, lambda w: sorted(w, reverse=True))) == list(range(n))

    def pairs(answer):
        def ask(window):
            if len(window) > 2:
                raise b.TokenOverflow
            return answer(window)

        return ask

    assert b.tournament(20, 16, pairs(max)) == 19 and b.rerank(20, 16, pairs(lambda w: sorted(w, reverse=True)), passes=0) == list(range(19, -1, -1))

    def never(window):
        raise b.TokenOverflow

    for call in (lambda: b.tournament(3, 2, never), lambda: b.rerank(3, 2, never), lambda: b.tournament(3, 1, never), lambda: b.rerank(3, 1, never)):
        with pytest.raises(ValueError, match="reduced to zero"):
            call()


def test_rerank_windows():
    windows = []

    def ask(window):
        windows.append(list(window))
        return sorted(window)

    assert b.rerank(17, 16, ask) == list(range(17)) and windows == [list(range(1, 17)), list(range(9))]
    assert b.rerank(4, 16, sorted, "window") == [2, 3, 0, 1] and b.rerank(4, 16, sorted) == [0, 1, 2, 3]
    assert b.rerank(1, 16, None) == [0] and b.rerank(0, 16, None) == []
    with pytest.raises(ValueError, match="twice"):
        b.rerank(3, 3, lambda w: [w[0], w[0]])
    with pytest.raises(ValueError, match="not among"):
        b.rerank(3, 3, lambda w: [7])


def test_rerank_puts_the_best_half_window_first():
    r = random.Random(1)
    for _ in range(200):
        n, size = r.randint(2, 60), r.randint(2, 20)
        score = r.sample(range(1000), n)
        best = sorted(range(n), key=score.__getitem__)
        ask = lambda w, s=score: sorted(w, key=s.__getitem__)
        k = n if n <= size else size // 2
        assert b.rerank(n, size, ask)[:k] == best[:k]
        assert b.rerank(n, size, ask, passes=0) == best


def test_rerank_keeps_every_row_whatever_overflows():
    r = random.Random(0)
    for _ in range(300):
        n, size = r.randint(0, 40), r.randint(1, 12)

        def ask(window):
            if r.random() < 0.3:
                raise b.TokenOverflow
            return r.sample(window, r.randint(0, len(window)))

        for order in ("relevance", "window"):
            try:
                assert sorted(b.rerank(n, size, ask, order)) == list(range(n))
            except ValueError as e:
                assert "reduced to zero" in str(e)
