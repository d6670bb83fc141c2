"""Connected components: of an edge table (the library's alternating star steps), and of pairs inside one task."""

from __future__ import annotations

from ..operators.graph import components  # noqa: F401


class Forest:
    """Union-find over 0..n-1 inside one task; the smallest member is the root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
