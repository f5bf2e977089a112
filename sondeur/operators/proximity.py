"""Term proximity as an expression: the best window of a query's terms in order, found in one fold over sorted positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The widest window that counts, the factor's base and growth with terms, how it saturates, and what a missed term costs.
WIDEST, BASE, EACH, SATURATION, MISSED = 200, 2.5, 0.5, 4.0, 4
_FAR = 2**31 - 1


def best_window(lists: Column, total: int, least: int) -> Column:
    """struct<window, missed> over `lists`, an array<array<int>> of the matched children's positions in query order.

    Positions are taken in ascending order.  A child below the expected one starts the match anew; a later one goes on
    and counts the children between as missed.  Of several children at one position the expected one counts, or else
    the first.  The best match misses fewest, then is narrowest; more than total - least misses don't count.
    """
    tagged = F.array_sort(F.flatten(F.transform(lists, lambda ps, i: F.transform(ps, lambda p: F.struct(p.alias("p"), i.cast("int").alias("c"))))))
    i32 = lambda v: F.lit(v).cast("int")
    names = ("start", "missed", "next", "best", "window")
    init = (i32(0), i32(0), i32(_FAR), i32(total - least), i32(_FAR))
    state = F.struct(
        F.struct(*[v.alias(n) for n, v in zip(names, init, strict=True)]).alias("now"),
        F.struct(*[v.alias(n) for n, v in zip(names, init, strict=True)]).alias("was"),
        i32(-1).alias("at"),
    )

    def step(s: Column, x: Column) -> Column:
        again = x["c"] < s["next"]
        missed = s["missed"] + x["c"] - s["next"]
        all_missed = missed + (i32(total) - x["c"] - i32(1))
        wide = x["p"] - s["start"]
        fewer = ~again & (all_missed < s["best"])
        same = ~again & (all_missed == s["best"]) & (wide < s["window"])
        return F.struct(
            F.when(again, x["p"]).otherwise(s["start"]).alias("start"),
            F.when(again, x["c"]).otherwise(missed).alias("missed"),
            (x["c"] + i32(1)).alias("next"),
            F.when(fewer, all_missed).otherwise(s["best"]).alias("best"),
            F.when(fewer | same, wide).otherwise(s["window"]).alias("window"),
        )

    def merge(s: Column, x: Column) -> Column:
        tie = x["p"] == s["at"]
        wanted = tie & (x["c"] == s["was"]["next"])
        now = F.when(wanted, step(s["was"], x)).when(tie, s["now"]).otherwise(step(s["now"], x))
        was = F.when(tie, s["was"]).otherwise(s["now"])
        return F.struct(now.alias("now"), was.alias("was"), x["p"].cast("int").alias("at"))

    return F.aggregate(tagged, state, merge, lambda s: F.struct(s["now"]["window"].alias("window"), s["now"]["best"].alias("missed")))


def factor(lists: Column, total: int, least: int) -> Column:
    """What a document's score is multiplied by, 1 without a window that counts."""


    def scored(best: Column) -> Column:
        # windows are compared before they are multiplied, so that none overflows
        wide = F.when(best["window"] <= WIDEST, best["window"] * (1 + best["missed"] * MISSED))
        return F.when(wide <= WIDEST, 1 + (BASE + EACH * total) / (SATURATION + wide)).otherwise(F.lit(1.0))

    # bound to a name of its own, so that the fold runs once and not once for each use
    return F.element_at(F.transform(F.array(best_window(lists, total, least)), scored), 1)


def phrase_factor(terms: int) -> float:
    return 1 + (BASE + EACH * terms) / (SATURATION + terms - 1)


def plain_factor(lists: list[list[int]], total: int, least: int) -> float:
    """The same by definition, in plain Python, with a cursor for each child."""
    at = [0] * len(lists)
    expected, start, missed = float("inf"), 0, 0
    best, window = total - least, float("inf")
    while True:
        live = [(lists[c][at[c]], c) for c in range(len(lists)) if at[c] < len(lists[c])]
        if not live:
            break
        position = min(live)[0]
        here = [c for p, c in live if p == position]
        child = int(expected) if expected in here else here[0]
        for c in here:
            at[c] += 1
        if child < expected:
            start, missed = position, child
        else:
            missed += child - int(expected)
            wide, all_missed = position - start, missed + total - child - 1
            if all_missed < best or (all_missed == best and wide < window):
                best, window = all_missed, wide
        expected = child + 1
    if window <= WIDEST and window * (1 + MISSED * best) <= WIDEST:
        return 1 + (BASE + EACH * total) / (SATURATION + window * (1 + MISSED * best))
    return 1.0
