"""What all tasks of a session share: limits, metrics and secrets, held by the driver.

Tasks talk to a listener on the driver, since limits hold for all of them together, counts from tasks cut short
by a LIMIT must not be lost, and secrets must not travel in plans. Its address and key travel with the call.
"""

from __future__ import annotations

import secrets as random_keys
import threading
import time
from collections import deque
from dataclasses import dataclass, field
from multiprocessing.connection import Client, Listener
from typing import Any

from lexispark.operators.batching import UsageExceeded

WINDOW = 60.0


class RateLimiter:
    """At most limit starts in any rolling window; bursts are allowed."""

    def __init__(self, window: float = WINDOW, clock=time.monotonic):
        self.window, self.clock, self.starts = window, clock, {}

    def wait(self, model: str, limit: int) -> float:
        """0 and the start is counted, or the seconds to wait before asking again."""
        now, starts = self.clock(), self.starts.setdefault(model, deque())
        while starts and now - starts[0] >= self.window:
            starts.popleft()
        if len(starts) < limit:
            starts.append(now)
            return 0.0
        return self.window - (now - starts[0])


class UsageMeter:
    """Tokens used by a model so far. A limit is soft: what crosses it still counts, the next request is refused."""

    def __init__(self):
        self.used: dict[str, list[int]] = {}

    def add(self, model: str, prompt: int, completion: int) -> None:
        own = self.used.setdefault(model, [0, 0])
        own[0] += prompt
        own[1] += completion

    def exceeded(self, model: str, limits: dict[str, int]) -> str | None:
        prompt, completion = self.used.get(model, (0, 0))
        have = {"prompt_tokens_limit": prompt, "completion_tokens_limit": completion, "total_tokens_limit": prompt + completion}
        return next((k for k, limit in limits.items() if have[k] >= limit), None)


@dataclass
class Record:
    """Counters of one use of a function."""

    function: str = ""
    model_name: str = ""
    provider: str = ""
    input_tokens: int = 0
    output_tokens: int = 0
    api_calls: int = 0
    api_duration_ms: float = 0.0
    execution_time_ms: float = 0.0
    order: int = 0
    parts: dict[str, int] = field(default_factory=dict)

    def as_dict(self) -> dict[str, Any]:
        return {
            "input_tokens": self.input_tokens,
            "output_tokens": self.output_tokens,
            "total_tokens": self.input_tokens + self.output_tokens,
            "api_calls": self.api_calls,
            "api_duration_ms": self.api_duration_ms,
            "execution_time_ms": self.execution_time_ms,
            "model_name": self.model_name,
            "provider": self.provider,
        }

    @property
    def empty(self) -> bool:
        return not (self.input_tokens or self.output_tokens or self.api_calls or self.execution_time_ms)


class Metrics:
    def __init__(self):
        self.records: dict[str, Record] = {}  # by call, in the order of first use
        self.by_task: dict[tuple[str, str], Record] = {}

    def add(self, call: str, task: str, function: str, model: str, provider: str, **counts: float) -> None:
        for records, key in ((self.records, call), (self.by_task, (task, call))):
            r = records.setdefault(key, Record(function, model, provider, order=len(records)))
            for name, n in counts.items():
                setattr(r, name, getattr(r, name) + n)

    def flat(self) -> dict[str, dict[str, Any]]:
        """{function_k: counters}: the k-th use of the function; uses without any count are left out."""
        out: dict[str, dict[str, Any]] = {}
        numbers: dict[str, int] = {}
        for r in self.records.values():
            if not r.empty:
                numbers[r.function] = numbers.get(r.function, 0) + 1
                out[f"{r.function}_{numbers[r.function]}"] = r.as_dict()
        return out

    def nested(self) -> dict[str, Any]:
        """By task (in the place of threads), use and function."""
        out: dict[str, Any] = {}
        for (task, call), r in self.by_task.items():
            if not r.empty:
                out.setdefault(task, {}).setdefault(call, {})[r.function] = r.as_dict() | {"registration_order": self.records[call].order + 1}
        return {"threads": out, "thread_count": len(out)}

    def reset(self) -> str:
        self.records.clear()
        self.by_task.clear()
        return "Metrics reset successfully"


class Service:
    """The state, and a listener for tasks' requests."""

    def __init__(self, host: str, window: float = WINDOW, bind: str | None = None):
        """host: the address that tasks use; bind: the one to listen at, where that is another."""
        self.lock = threading.Lock()
        self.rates, self.usage, self.metrics = RateLimiter(window), UsageMeter(), Metrics()
        self.secrets: dict[str, dict[str, str]] = {}
        self.key = random_keys.token_bytes(32)
        self.listener = Listener((bind or host, 0), authkey=self.key, backlog=256)
        self.host = host
        threading.Thread(target=self._accept, daemon=True).start()

    @property
    def handle(self) -> Handle:
        return Handle((self.host, self.listener.address[1]), self.key)

    def _accept(self) -> None:
        while True:
            try:
                connection = self.listener.accept()
            except OSError:
                return  # closed
            except Exception:  # noqa: BLE001  a stranger without the key
                continue
            threading.Thread(target=self._serve, args=(connection,), daemon=True).start()

    def _serve(self, connection) -> None:
        try:
            while True:
                what, args = connection.recv()
                with self.lock:
                    answer = self._answer(what, args)
                connection.send(answer)
        except (EOFError, OSError):  # the task has gone
            pass
        except Exception:  # noqa: BLE001  a request that can't be answered ends its own connection only
            pass
        finally:
            connection.close()

    def _answer(self, what: str, args: tuple) -> Any:
        if what == "wait":
            return self.rates.wait(*args)
        if what == "exceeded":
            return self.usage.exceeded(*args)
        if what == "used":
            model, prompt, completion, record = args
            self.usage.add(model, prompt, completion)
            self.metrics.add(**record)
            return None
        if what == "secret":
            return self.secrets.get(args[0], {})
        raise ValueError(what)

    def close(self) -> None:
        self.listener.close()


@dataclass(frozen=True, repr=False)
class Handle:
    """Reaches the service from a task."""

    address: Any
    key: bytes

    def connect(self) -> Connection:
        return Connection(self)


class Connection:
    def __init__(self, handle: Handle):
        self.handle, self.lock, self.pipe = handle, threading.Lock(), None

    def ask(self, what: str, *args: Any) -> Any:
        with self.lock:
            if self.pipe is None:
                self.pipe = Client(self.handle.address, authkey=self.handle.key)
            self.pipe.send((what, args))
            return self.pipe.recv()

    def start(self, model: str, rate_limit: int | None, usage_limit: dict[str, int]) -> None:
        """Returns once a request may be sent."""
        if usage_limit and (which := self.ask("exceeded", model, usage_limit)):
            raise UsageExceeded(f"{which} of {model} is reached")
        while rate_limit and (seconds := self.ask("wait", model, rate_limit)) > 0:
            time.sleep(min(seconds, 5.0) + 0.001)

    def close(self) -> None:
        if self.pipe is not None:
            self.pipe.close()
            self.pipe = None
