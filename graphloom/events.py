"""In-process events of the driver: handlers by name, errors kept apart, counts of what was delivered."""

from __future__ import annotations

import logging
from collections import Counter
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger(__name__)
Handler = Callable[[Any], None]


class EventBus:
    """Handlers of an event run side by side; an error of one is logged and does not reach the others or the emitter."""

    def __init__(self) -> None:
        self._handlers: dict[str, list[Handler]] = {}
        self.emitted: Counter[str] = Counter()

    def on(self, event: str, handler: Handler) -> None:
        self._handlers.setdefault(event, []).append(handler)

    def off(self, event: str, handler: Handler) -> None:
        if handler in self._handlers.get(event, []):
            self._handlers[event].remove(handler)

    def handlers(self, event: str) -> int:
        return len(self._handlers.get(event, []))

    def emit(self, event: str, payload: Any = None) -> None:
        """Only events that somebody listens to are counted."""
        handlers = list(self._handlers.get(event, []))
        if not handlers:
            return
        self.emitted[event] += 1
        with ThreadPoolExecutor(len(handlers)) as pool:
            for handler, done in [(h, pool.submit(h, payload)) for h in handlers]:
                try:
                    done.result()
                except Exception:
                    log.exception("handler %r of %s failed", handler, event)

    def clear(self) -> None:
        self._handlers.clear()
        self.emitted.clear()


class ProgressListener(StreamingQueryListener):
    """Progress of streaming queries as events of a bus."""

    def __init__(self, bus: EventBus):
        self.bus = bus

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.bus.emit("stream.started", event)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.bus.emit("stream.progress", event.progress)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.bus.emit("stream.idle", event)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.bus.emit("stream.terminated", event)
