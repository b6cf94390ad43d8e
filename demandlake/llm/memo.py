"""A bounded memo of computed values: two generations, the older one is dropped when the
younger is full, so frequent keys stay."""

from __future__ import annotations

from collections.abc import Callable


class Memo(dict):
    """``memo[key]`` computes a missing value; at most about ``2 * limit`` values are held."""

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key):
        value = self.older.pop(key, None)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value

    def trim(self) -> None:
        """Call between batches."""
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()
