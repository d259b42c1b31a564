"""Two ladders of price levels in exact units, and what makes a pair of them unusable."""

from __future__ import annotations

import bisect
import functools
from decimal import Decimal


@functools.lru_cache(maxsize=1 << 16, typed=True)
def to_units(value: str, unit: str) -> int:
    """value / unit as an integer; raises where it isn't one, never rounds."""
    if not isinstance(value, (str, Decimal)):
        raise TypeError("prices and quantities are text")
    n = Decimal(value) / Decimal(unit)
    if not n.is_finite() or n < 0 or n != n.to_integral_value():
        raise ValueError(f"{value} isn't a multiple of {unit}")
    return int(n)


class Ladder:
    """One side: quantities by price, and the prices in order, best first; bids are kept negated, so the best is the smallest.

    px and amounts are prices and quantities in the same order as doubles: sign, tick and step turn units into these.
    """

    def __init__(self, levels=(), sign: int = 1, tick: float = 1.0, step: float = 1.0):
        self.sign, self.tick, self.step = sign, tick, step
        self.qty: dict[int, int] = dict(levels)
        self.order = sorted(self.qty)
        self.px = [round(sign * p * tick, 10) for p in self.order]
        self.amounts = [round(self.qty[p] * step, 10) for p in self.order]

    def set(self, price: int, qty: int) -> None:
        if qty:
            at = bisect.bisect_left(self.order, price)
            if price in self.qty:
                self.amounts[at] = round(qty * self.step, 10)
            else:
                self.order.insert(at, price)
                self.px.insert(at, round(self.sign * price * self.tick, 10))
                self.amounts.insert(at, round(qty * self.step, 10))
            self.qty[price] = qty
        elif self.qty.pop(price, None) is not None:
            at = bisect.bisect_left(self.order, price)
            del self.order[at], self.px[at], self.amounts[at]


class Ladders:
    """Both sides. touched holds what changed since it was last emptied, per side; None stands for all of it."""

    def __init__(self, tick: str, step: str):
        self.tick, self.step = tick, step
        self.load([[], []], [None, None])

    def load(self, sides: list, edges: list) -> None:
        """Take levels in units, and per side the price beyond which nothing is known (None: all is)."""
        px, qty = float(self.tick), float(self.step)
        self.sides, self.edges, self.touched = [Ladder(x, sign, px, qty) for x, sign in zip(sides, (-1, 1))], list(edges), [None, None]

    def parsed(self, bids, asks) -> list:
        """Levels of both sides in units; raises on what isn't exact, before anything changes."""
        return [[(sign * to_units(p, self.tick), to_units(q, self.step)) for p, q in side] for side, sign in ((bids, -1), (asks, 1))]

    def replace(self, sides: list, limit: int | None) -> None:
        """Take a snapshot; a side as long as its limit may go on behind its last level."""
        kept = [[(p, q) for p, q in side if q] for side in sides]
        full = [bool(limit and len(side) >= limit and own) for side, own in zip(sides, kept)]
        self.load(kept, [max(p for p, _ in own) if f else None for own, f in zip(kept, full)])

    def change(self, sides: list) -> None:
        for n, side in enumerate(sides):
            for price, qty in side:
                self.sides[n].set(price, qty)
                if self.touched[n] is not None:
                    self.touched[n].add(price)

    def fault(self, top: int) -> str | None:
        """Why the best `top` levels can't be relied on."""
        bids, asks = self.sides
        if bids.order and asks.order and -bids.order[0] >= asks.order[0]:
            return "crossed_book"
        for side, edge in zip(self.sides, self.edges):
            if edge is not None and (len(side.order) < top or side.order[top - 1] > edge):
                return "top_levels_coverage_unconfirmed"
        return None

    def best(self, top: int) -> tuple:
        """bid_px, bid_qty, ask_px, ask_qty of the best levels as doubles."""
        return tuple(x for side in self.sides for x in (side.px[:top], side.amounts[:top]))
