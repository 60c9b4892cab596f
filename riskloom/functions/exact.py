"""Sums of doubles that are exact, whatever their order, and can be taken from again.

A double is cut into whole numbers of ``BITS`` bits on a fixed grid of powers of two; sums of these are sums of longs. Only their
total is rounded, once, to the nearest double. A grid holds the bins that the values of a column reach, found by one aggregate.
NaN and infinities are counted beside the digits. A column of longs holds the sum of 2**33 values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 28
#: Values that no digits hold: a NaN, an infinity up, an infinity down.
ODD = {"nan": float("nan"), "up": math.inf, "down": -math.inf}


def _scaled(x: Column, exponent: int) -> Column:
    """``x * 2**exponent``, in steps that a double can hold."""
    while exponent:
        step = max(-1000, min(1000, exponent))
        x, exponent = x * F.lit(2.0 ** step), exponent - step
    return x


def finite(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x.isin(*ODD.values()), F.lit(0.0)).otherwise(x)


def product(x: Column, y: Column) -> tuple[Column, Column]:
    """A product of doubles and what its rounding left over, exactly, while nothing overflows or underflows."""
    def halves(v: Column) -> tuple[Column, Column]:
        c = v * F.lit(134217729.0)
        high = c - (c - v)
        return high, v - high

    p, (a, b), (c, d) = x * y, halves(x), halves(y)
    return p, ((a * c - p) + a * d + b * c) + b * d


@dataclass(frozen=True)
class Grid:
    """Bins ``low`` to ``high``: bin b counts multiples of ``2**(BITS * b)``."""

    low: int
    high: int

    @classmethod
    def covering(cls, df: DataFrame, x: Column, squares: bool = False) -> Grid:
        """The grid of all values of ``x``, or of their exact squares."""
        size = F.abs(finite(x))
        exponent = F.floor(F.log2(F.when(size > 0, size)))
        low, high = df.agg(F.min(exponent), F.max(exponent)).first()
        if low is None:
            return cls(0, 0)
        if squares:
            return cls(math.floor((2 * low - 112) / BITS), math.floor((2 * high + 4) / BITS))
        return cls(math.floor((low - 54) / BITS), math.floor((high + 2) / BITS))

    def digits(self, x: Column) -> list[Column]:
        """Whole numbers of a finite ``x``, lowest bin first; their sum over the grid is ``x``.

        Each is what rounding to multiples of its bin has over rounding to multiples of the next one.
        """
        x, out = finite(x), []
        for b in range(self.low, self.high + 1):
            digit = F.rint(_scaled(x, -BITS * b))
            if b < self.high:
                digit = digit - F.rint(_scaled(x, -BITS * (b + 1))) * F.lit(2.0 ** BITS)
                above = BITS * (b + 1) + 55  # a double this large has no bits as low
                if above < 1024:
                    digit = F.when(F.abs(x) < F.lit(2.0 ** above), digit).otherwise(F.lit(0.0))
            out.append(digit.cast("long"))
        return out

    def rounded(self, sums: list[Column]) -> Column:
        """The double nearest to sums of digits.

        Carrying leaves digits from -2**(BITS - 1) to below 2**(BITS - 1). The highest that is not zero and the two below it hold
        more bits than a double; of all others only the sign matters.
        """
        carry, half, digits = F.lit(0).cast("long"), F.lit(1 << (BITS - 1)), []
        for s in [*sums, F.lit(0).cast("long"), F.lit(0).cast("long")]:
            whole = s + carry
            carry = F.shiftright(whole + half, BITS)
            digits.append(whole - F.shiftleft(carry, BITS))

        def value(d: Column) -> Column:
            out = F.lit(0.0)
            for k in range(len(digits)):  # the highest decides, so it comes last
                base = max(0, k - 2)
                lead = F.lit(0).cast("decimal(38,0)")
                for j in range(base, k + 1):
                    lead = lead + d[j].cast("decimal(12,0)") * F.lit(1 << (BITS * (j - base) + 1)).cast("decimal(20,0)")
                tail = F.lit(0).cast("long")
                for j in range(base):
                    tail = F.when(d[j] != 0, d[j]).otherwise(tail)
                whole = (lead + F.signum(tail).cast("decimal(2,0)")).cast("double")
                out = F.when(d[k] != 0, _scaled(whole, BITS * (self.low + base) - 1)).otherwise(out)
            return out

        return F.transform(F.array(F.array(*digits)), value)[0]  # the digits are worked out once


@dataclass(frozen=True)
class ExactSum:
    """A sum of a column by names: which columns a row gives, and the value of their totals. The sum of no values is null."""

    grid: Grid
    name: str

    @property
    def columns(self) -> list[str]:
        return [f"_{self.name}_{part}" for part in (*range(self.grid.high - self.grid.low + 1), *ODD, "some")]

    def given(self, *terms: Column) -> dict[str, Column]:
        """Columns of a row whose value is the sum of ``terms``."""
        def of(x: Column) -> list[Column]:
            x = x.cast("double")
            odd = [(x == F.lit(v)).cast("long") for v in ODD.values()]
            return [F.coalesce(c, F.lit(0).cast("long")) for c in (*self.grid.digits(x), *odd, x.isNotNull().cast("long"))]

        parts = [of(t) for t in terms]
        return dict(zip(self.columns, [sum(p[1:], p[0]) for p in zip(*parts)]))

    def value(self, total=F.col) -> Column:
        """The rounded value; ``total`` gives each column's total by name."""
        *sums, nan, up, down, some = [total(c) for c in self.columns]
        odd = F.when((nan > 0) | ((up > 0) & (down > 0)), F.lit(ODD["nan"])).when(up > 0, F.lit(ODD["up"])).when(down > 0, F.lit(ODD["down"]))
        return F.when(some > 0, F.coalesce(odd, self.grid.rounded(sums)))

    def left_over(self, value: Column, total=F.col) -> Column:
        """What rounding left of the total: 0 where it is odd."""
        sums = [total(c) for c in self.columns[:-4]]
        return self.grid.rounded([s - d for s, d in zip(sums, self.grid.digits(F.coalesce(value, F.lit(0.0))))])
