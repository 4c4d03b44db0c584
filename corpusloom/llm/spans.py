"""Spans of regular expressions as Column expressions: places in code points, end exclusive.

Running totals over an array are taken in chunks, so a text with very many matches costs little more than linear time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,e:int,m:string>>"
PLACE = "array<struct<s:int,e:int>>"
#: Elements of an array that one fold gathers.
CHUNK = 256
_FAR = 2**31 - 1


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _last(a: Column) -> Column:
    return F.get(a, F.size(a) - 1)


def running(xs: Column, zero: int, op: Callable[[Column, Column], Column]) -> Column:
    """``op`` over each beginning of an array of integers: the value at a place includes its own element."""
    none = F.array().cast("array<int>")

    def part(chunk: Column) -> Column:
        return F.aggregate(chunk, none, lambda a, x: F.concat(a, F.array(op(F.coalesce(_last(a), F.lit(zero)), x).cast("int"))))

    def joined(parts: Column) -> Column:
        ends = F.transform(F.slice(parts, 1, F.size(parts) - 1), _last)
        before = F.aggregate(ends, F.array(F.lit(zero)), lambda a, x: F.concat(a, F.array(op(_last(a), x).cast("int"))))
        return F.flatten(F.zip_with(parts, before, lambda c, b: F.transform(c, lambda x: op(b, x).cast("int"))))

    def whole(v: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int"))
        return once(F.transform(chunks, lambda i: part(F.slice(v, i * CHUNK + 1, F.lit(CHUNK)))), joined)

    return once(xs, lambda v: F.when(F.size(v) == 0, none).otherwise(whole(v)))


def plus(a: Column, b: Column) -> Column:
    return a + b


def cut(text: Column, pattern: str) -> Column:
    """Pieces of ``text``: array of struct(g: text before a match, m: the match, null in the last piece)."""
    return F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(g.alias("g"), m.alias("m")))


def ends_of(pieces: Column) -> Column:
    """The place after each piece's match."""
    return running(F.transform(pieces, lambda x: F.length(x["g"]) + F.coalesce(F.length(x["m"]), F.lit(0))), 0, plus)


def find_spans(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """All leftmost non-overlapping matches of a Java ``pattern``, as ``SPAN``.

    The pieces between the matches come from a split at the same pattern; adding up lengths gives the places. Texts that
    fail ``guard``, a cheap test that each match passes, are not searched.
    """

    def spans(pieces: Column) -> Column:
        placed = F.zip_with(pieces, ends_of(pieces), lambda x, e: F.when(x["m"].isNotNull(), F.struct((e - F.length(x["m"])).alias("s"), e.alias("e"), x["m"].alias("m"))))
        return F.slice(placed, 1, F.size(placed) - 1)  # the last piece has no match

    test = text.rlike(pattern) if guard is None else guard & text.rlike(pattern)
    return F.when(test, once(cut(text, pattern), spans)).otherwise(F.array().cast(SPAN))


def places(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))


def ranked(kinds: list[tuple[str, Column]], by_start: bool) -> Column:
    """The spans of several kinds in one array of (first, second, e, kind), sorted by start then kind or by kind then start."""
    each = []
    for rank, (kind, spans) in enumerate(kinds):
        each.append(F.transform(spans, _entry(rank, kind, by_start)))
    return F.array_sort(F.concat(*each))


def _entry(rank: int, kind: str, by_start: bool):
    place = lambda x: (x["s"], F.lit(rank)) if by_start else (F.lit(rank), x["s"])
    return lambda x: F.struct(place(x)[0].alias("k1"), place(x)[1].alias("k2"), x["e"].alias("e"), F.lit(kind).alias("kind"))


def written(spans: Column, by_start: bool) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["k1" if by_start else "k2"], x["e"])), ",")


def clear_of(spans: Column, taken: list[Column]) -> Column:
    """``spans`` that overlap none of ``taken``: all are sorted by start, and the taken ones' greatest end so far and least start to come are carried along."""
    others = [F.transform(t, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(-1).alias("i"))) for t in taken]

    def test(all_: Column) -> Column:
        own = F.transform(all_, lambda x, i: F.struct(x["s"].alias("s"), x["e"].alias("e"), i.alias("i")))
        return once(F.array_sort(F.concat(own, *others)), lambda every: carry(all_, every))

    def carry(all_: Column, every: Column) -> Column:
        reached = running(F.transform(every, lambda x: F.when(x["i"] < 0, x["e"]).otherwise(0)), 0, F.greatest)
        ahead = F.reverse(running(F.transform(F.reverse(every), lambda x: F.when(x["i"] < 0, x["s"]).otherwise(_FAR)), _FAR, F.least))
        around = F.zip_with(reached, ahead, lambda r, a: F.struct(r.alias("r"), a.alias("a")))
        free = F.zip_with(every, around, lambda x, y: F.when((x["i"] >= 0) & (y["r"] <= x["s"]) & (y["a"] >= x["e"]), x["i"]))
        return F.transform(F.array_sort(F.filter(free, lambda i: i.isNotNull())), lambda i: F.get(all_, i))

    some = F.lit(False)
    for t in taken:
        some = some | (F.size(t) > 0)
    return F.when(some, once(spans, lambda all_: F.when(F.size(all_) > 0, test(all_)).otherwise(all_))).otherwise(spans)
