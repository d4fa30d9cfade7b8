"""Pluggable handlers that become one ordered conditional expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Handlers:
    """Named conditions by priority, lowest first; the first that holds names the result."""

    def __init__(self, default: str | None = None) -> None:
        self.default, self._rules = default, {}

    def register(self, name: str, condition: Column, priority: int = 100) -> Handlers:
        self._rules[name] = (priority, len(self._rules), condition)
        return self

    def unregister(self, name: str) -> Handlers:
        self._rules.pop(name, None)
        return self

    def column(self) -> Column:
        out = F.lit(None).cast("string") if self.default is None else F.lit(self.default)
        for name, (_, _, condition) in sorted(self._rules.items(), key=lambda x: x[1][:2], reverse=True):
            out = F.when(condition, F.lit(name)).otherwise(out)
        return out
