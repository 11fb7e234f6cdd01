"""BK-trees of fingerprints."""

from __future__ import annotations


class BKTree:
    """BK-tree over 64-bit ints: each node's children are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, v: int) -> None:
        k = len(self.value)
        self.value.append(v)
        self.children.append({})
        if not k:
            return
        at = 0
        while True:
            d = (v ^ self.value[at]).bit_count()
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = k
                return
            at = nxt

    def within(self, v: int, radius: int) -> list[int]:
        """Positions of the values at the given distance or nearer."""
        found, stack = [], [0] if self.value else []
        while stack:
            at = stack.pop()
            d = (v ^ self.value[at]).bit_count()
            if d <= radius:
                found.append(at)
            kids = self.children[at]
            if kids:
                stack.extend(k for e, k in kids.items() if d - radius <= e <= d + radius)
        return found
