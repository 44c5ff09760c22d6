"""A keyed permutation of the whole numbers below n, computed for each number on its own.

Numbers are cells of a grid of ``a`` by ``b``. Rounds of a Feistel network add a keyed draw of the column to the row number, and
one of the row to the column number, in turn; each round can be undone, so all of them together permute the cells. The grid
has hardly more cells than n; a number that lands on one too many is permuted again until it doesn't (cycle walking). How
often that can happen is known beforehand, since the few cells too many can be followed one by one.
"""

from __future__ import annotations

import functools
import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .draws import digest, integer

ROUNDS = 4
# Numbers of rows that are tried for the grid, from the square root of n on.
SIDES = 1000
_DIGITS = 15


@dataclass(frozen=True)
class Permutation:
    """A permutation of ``range(n)`` drawn for a key of text and numbers."""

    n: int
    key: tuple[str | int, ...]

    @functools.cached_property
    def grid(self) -> tuple[int, int]:
        """Sides of the grid: of all sides tried the one that leaves the fewest cells over, the shortest among equals."""
        side = math.isqrt(max(self.n, 1) - 1) + 1
        return min(((a, -(-max(self.n, 1) // a)) for a in range(side, side + SIDES)), key=lambda s: (s[0] * s[1], s[0]))

    def _cell(self, x: int) -> int:
        """Where one pass of all rounds takes a cell, as the column expression does."""
        a, b = self.grid
        row, column = divmod(x, b)
        for k in range(ROUNDS):
            text = "|".join(str(p) for p in (*self.key, k, row if k % 2 else column))
            drawn = int(hashlib.md5(text.encode()).hexdigest()[:_DIGITS], 16)
            row, column = (row, (column + drawn % b) % b) if k % 2 else ((row + drawn % a) % a, column)
        return row * b + column

    @functools.cached_property
    def passes(self) -> int:
        """Passes after which every number has landed below n."""
        a, b = self.grid
        most = 0
        for x in range(self.n, a * b):
            steps, at = 1, self._cell(x)
            while at >= self.n:
                steps, at = steps + 1, self._cell(at)
            most = max(most, steps)
        return 1 + most

    def _pass(self, x: Column, back: bool) -> Column:
        a, b = self.grid
        order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
        sign = -1 if back else 1

        def one(cell: Column, k: Column) -> Column:
            row, column = cell["row"], cell["column"]
            down = F.pmod(row + sign * integer(digest(*self.key, k, column), a, digits=_DIGITS), F.lit(a).cast("bigint"))
            along = F.pmod(column + sign * integer(digest(*self.key, k, row), b, digits=_DIGITS), F.lit(b).cast("bigint"))
            odd = k % 2 == 1
            return F.struct(F.when(odd, row).otherwise(down).alias("row"), F.when(odd, along).otherwise(column).alias("column"))

        rest = F.pmod(x, F.lit(b).cast("bigint"))
        start = F.struct(((x - rest) / b).cast("bigint").alias("row"), rest.alias("column"))
        return F.aggregate(F.array(*map(F.lit, order)), start, one, lambda cell: cell["row"] * b + cell["column"])

    def _walk(self, x: Column, back: bool) -> Column:
        if self.n < 2:
            return x.cast("bigint")
        landed = self._pass(x.cast("bigint"), back)
        if self.passes == 1:
            return landed
        again = F.array_repeat(F.lit(0), self.passes - 1)
        return F.aggregate(again, landed, lambda at, _: F.when(at < self.n, at).otherwise(self._pass(at, back)))

    def of(self, x: Column) -> Column:
        """Place of a number."""
        return self._walk(x, False)

    def at(self, place: Column) -> Column:
        """Number at a place."""
        return self._walk(place, True)

    def next(self, x: Column) -> Column:
        """The number at the place behind that of ``x``, in a circle: another one if there is any, and no two have the same."""
        return self.at(F.pmod(self.of(x) + 1, F.lit(max(self.n, 1)).cast("bigint")))
