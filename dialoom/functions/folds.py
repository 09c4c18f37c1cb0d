"""Scans over a row's array, and values that an expression names.

A fold copies its state at each step, so a list in that state makes it
quadratic. A scan here carries a state of bounded size only: one fold over
pieces of the array finds the state that each piece is entered with, then each
piece is folded by itself with a list of no more than its own elements.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and hand it to `body`, inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def emitted(items: Column, zero: Column, step: Callable, emits: Callable, out: Callable, kind: str) -> Column:
    """Array (elements of DDL type `kind`) of `out(state, item)` wherever `emits(state, item)`; `step(state, item)` is the next state.

    `zero` and the states are structs of the same fields. Null and empty
    arrays give an empty one.
    """

    def scan(xs: Column) -> Column:
        own = lambda c: F.sequence(c * PIECE, F.least(c * PIECE + PIECE, F.size(xs)) - 1)
        pieces = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / PIECE).cast("int"))
        through = lambda s, c: F.aggregate(own(c), s, lambda a, i: step(a, F.get(xs, i)))
        # States are kept as an array, one for each piece; what the last one is left with is of no use.
        first = F.struct(zero.alias("now"), F.array(zero).alias("entered"))
        more = lambda a, c: let(through(a["now"], c), lambda s: F.struct(s.alias("now"), F.concat(a["entered"], F.array(s)).alias("entered")))
        entered = F.aggregate(let(pieces, lambda p: F.slice(p, F.lit(1), F.size(p) - 1)), first, more, lambda a: a["entered"])

        def piece(s: Column, c: Column) -> Column:
            start = F.struct(s.alias("now"), F.array().cast(f"array<{kind}>").alias("found"))

            def add(a: Column, i: Column) -> Column:
                x = F.get(xs, i)
                found = F.when(emits(a["now"], x), F.concat(a["found"], F.array(out(a["now"], x)))).otherwise(a["found"])
                return F.struct(step(a["now"], x).alias("now"), found.alias("found"))

            return F.aggregate(own(c), start, add, lambda a: a["found"])

        return F.flatten(F.transform(entered, piece))

    return F.when(F.size(items) > 0, let(items, scan)).otherwise(F.array().cast(f"array<{kind}>"))
