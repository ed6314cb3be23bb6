"""Engines that are called side by side under one deadline, in the Python worker that holds their crops.

Each engine has a thread of its own, which nobody waits for beyond the deadline: an engine that hangs loses that thread, not the
worker. The answers that came late are dropped. An engine is not safe to be called twice at once, so a later call waits for an
abandoned one, up to its own deadline; after a streak of time-outs an engine is not called any more in the task.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from queue import Empty, SimpleQueue

import pandas as pd
from pyspark.sql import DataFrame

from quoin.operators.progress import STREAK
from quoin.session import ship
from quoin.sources.readings import failure_of

#: A recogniser: a list of images -> [(text, score), ...] of the same length.
Recogniser = Callable[[list], list[tuple[str, float]]]


#: Readings that a task gathers before they go back to Spark.
GATHERED = 1000


def _serve(name: str, asked: SimpleQueue) -> None:
    """The calls of one engine, one after the other, until None comes."""
    for call, deadline, back in iter(asked.get, None):
        if time.monotonic() < deadline:  # else it waited for an abandoned call; nobody asks for the answer
            try:
                answer = (call(), None)
            except BaseException as e:  # an engine that fails, or exits, never fails the run
                answer = (None, failure_of(e)[0])
            back.put((name, answer))
            del answer
        del call, back  # nothing is held while there is nothing to do


class Calls:
    """Calls of named engines in one worker; keeps their threads, which end with it, and streaks."""

    def __init__(self, streak: int = STREAK):
        self.streak, self._asked, self._late = streak, {}, {}

    def __del__(self):
        for asked in self._asked.values():
            asked.put(None)

    def off(self, name: str) -> bool:
        return self._late.get(name, 0) >= self.streak

    def _ask(self, name: str, call: Callable[[], object], deadline: float, back: SimpleQueue) -> None:
        if name not in self._asked:
            self._asked[name] = SimpleQueue()
            threading.Thread(target=_serve, args=(name, self._asked[name]), daemon=True, name=f"engine-{name}").start()
        self._asked[name].put((call, deadline, back))

    def answers(self, calls: dict[str, Callable[[], object]], seconds: float) -> dict[str, tuple[object, str | None]]:
        """(answer, None) of each call that is back within `seconds` of now, whatever their number; (None, 'timeout') of those
        that are not, (None, 'off') of engines that are left out, and (None, kind of failure) of those that failed."""
        deadline, back, found = time.monotonic() + seconds, SimpleQueue(), {}
        asked = [n for n in calls if not self.off(n)]
        for name in asked:
            self._ask(name, calls[name], deadline, back)
        try:
            while len(found) < len(asked):
                name, answer = back.get(timeout=max(0.0, deadline - time.monotonic()))
                found[name] = answer
        except Empty:
            pass
        for name in asked:
            self._late[name] = 0 if name in found else self._late.get(name, 0) + 1
        return {n: found[n] if n in found else (None, "timeout" if n in asked else "off") for n in calls}


class EngineGroup:
    """Several recognisers over the same crops: `engines` names them in their order, each with what makes it, once a task.
    All engines together have `seconds` for each batch of crops."""

    def __init__(self, engines: dict[str, Callable[[], Recogniser]], seconds: float, image: str = "image", batch: int = 16, streak: int = STREAK):
        self.engines, self.seconds, self.image, self.batch, self.streak = engines, seconds, image, batch, streak

    def read(self, crops: DataFrame) -> DataFrame:
        """crops' other columns with engine_ord, engine, text, score and failure: ('', 0.0) and why ('timeout', 'off', 'format',
        ...) for each crop of a batch that an engine did not answer in time, or not with as many readings."""
        ship(crops.sparkSession)
        rest = [c for c in crops.columns if c != self.image]
        engines, seconds, image, size, streak = self.engines, self.seconds, self.image, self.batch, self.streak

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            made, calls = {name: load() for name, load in engines.items()}, Calls(streak)
            for b in batches:
                crops, keys, at, rows = b[image].tolist(), b[rest], [], []
                for i in range(0, len(b), size):
                    images = crops[i : i + size]
                    found = calls.answers({n: lambda f=f: list(f(images)) for n, f in made.items()}, seconds)  # noqa: B023
                    for k, (name, (got, why)) in enumerate(found.items()):
                        if why is None and len(got) != len(images):
                            why = "format"
                        got = got if why is None else [("", 0.0)] * len(images)
                        at += range(i, i + len(images))
                        rows += [(k, name, t, float(s), why) for t, s in got]
                    if len(rows) >= GATHERED or rows and i + size >= len(b):
                        ordinals, names, texts, scores, whys = zip(*rows, strict=True)
                        yield keys.iloc[at].assign(engine_ord=ordinals, engine=names, text=texts, score=scores, failure=whys)
                        at, rows = [], []

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in crops.select(*rest).schema.fields)
        return crops.mapInPandas(run, f"{kinds}, engine_ord int, engine string, text string, score double, failure string")


def detect_in_time(find: Callable[[dict], list], calls: Calls, seconds: float, name: str = "detector") -> Callable[[dict], list]:
    """A detector for BoxSource that has `seconds` a page: a page on which it hangs has no boxes, and one that hung too often
    is not called any more."""

    def within(image: dict) -> list:
        got, why = calls.answers({name: lambda: list(find(image))}, seconds)[name]
        if why is not None:
            raise TimeoutError(why)
        return got

    return within
