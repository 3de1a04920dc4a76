"""Run profiles: named entries in groups, timers, and a YAML dump."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from vicinal.options import Profiling


#: Progress of fits and searches; set its level to INFO to see it.
LOG = logging.getLogger("vicinal")


class Profiler:
    """Two-level entries group -> name -> value; without profiling, dump() writes nothing."""

    def __init__(self, kind: Profiling = Profiling.NONE):
        self.kind = Profiling.parse(kind)
        self.entries: dict[str, dict[str, object]] = {}
        self.events: list[tuple[float, str]] = []

    def add(self, group: str, name: str, value: object) -> None:
        self.entries.setdefault(group, {})[name] = value

    def event(self, name: str) -> None:
        self.events.append((time.time(), name))

    @contextmanager
    def timed(self, group: str, name: str) -> Iterator[None]:
        """Records the wall-clock time of a block in milliseconds, and events at its ends."""
        self.event(f"{group}_start")
        began = time.perf_counter()
        yield
        took = f"{(time.perf_counter() - began) * 1000:.0f}ms"
        self.add(group, name, took)
        LOG.info("%s: %s %s", group, name, took)
        self.event(f"{group}_end")

    def clear(self) -> None:
        self.entries, self.events = {}, []

    def text(self) -> str:
        groups = {k: dict(v) for k, v in self.entries.items()}
        groups.setdefault("metadata", {})["date"] = f"{datetime.now(UTC):%Y-%m-%d %H:%M:%S}"
        if self.events:
            groups["events"] = {f"{i:03d}_{name}": f"{t - self.events[0][0]:.3f}s" for i, (t, name) in enumerate(self.events)}
        return "---\n" + "".join(f"{g}:\n" + "".join(f"  {n}: {v}\n" for n, v in sorted(e.items())) + "\n" for g, e in sorted(groups.items()))

    def dump(self, path: str) -> None:
        """Appends the profile to a file."""
        if self.kind is not Profiling.NONE:
            with open(path, "a") as f:
                f.write(self.text())
