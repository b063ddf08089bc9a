"""Penalised change points of daily series, by array functions alone.

A series is first summed by key and day, where tasks sum what they have read, so what is grouped by key is a row a day and no more. A key's days are
then one array, and aggregate() folds over it. Its state is a list with a place for each day so far, the newest first: the least cost of a
segmentation that ends there, how many segments that takes and where its last one begins, in one number in this order, and running sums. A day
looks at all places that are at least a segment away and takes the least of them. As the best of a place was chosen by the
same order, ties end with the fewest segments and with the earliest starts, compared from the last segment backwards. A second fold walks
back from the last day.

Sums of squares are whole numbers: 64-bit ones where (number of days) x (sum of absolute totals)^2 fits into them, which is a bound of all that
is computed, else decimals of 38 digits; what doesn't fit into those, or a spread that isn't a long, fails instead of being wrong (in ANSI mode, Spark's default). A key's work grows with the square of its days, its memory with them; no rows of
several keys meet in one place.

Edge cases: rows whose value or time is null have no part; null keys are a series of their own; days without rows count 0; repeated rows
count as often as they are there; a series shorter than two segments is one; other columns aren't read; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORTEST, PENALTY = 5, 10_000
WIDE = "decimal(38,0)"
_MOST = 44_000  # a day costs less: 1000 times the logarithm of what fits into 63 bits


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def daily(rows: DataFrame, key: Column, time: Column, value: Column) -> DataFrame:
    """(key, first, totals): the sum of each day from a key's first to its last day with rows, 0 for days without. The key's columns keep their names."""
    taken = rows.select(key.alias("key"), F.unix_date(F.to_date(time)).alias("day"), value.cast("long").alias("value")).where("day IS NOT NULL AND value IS NOT NULL")
    days = taken.groupBy("key", "day").agg(F.sum("value").alias("total"))
    # Dealt to a number of partitions of its own, which isn't coalesced: rows are few and narrow here, the work on each key is not.
    dealt = days.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    listed = dealt.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("day", "total"))).alias("days"))
    gap = lambda x, i: F.when(i > 0, x["day"] - F.col("days")[F.greatest(i - 1, F.lit(0))]["day"] - 1).otherwise(0)
    totals = F.flatten(F.transform("days", lambda x, i: F.concat(F.array_repeat(F.lit(0).cast("long"), gap(x, i)), F.array(x["total"]))))
    return listed.select("key", F.col("days")[0]["day"].alias("first"), totals.alias("totals"))


def _spread(days: Column, s: Column, q: Column, wide: bool, square: Column | None = None) -> Column:
    """1 + the whole part of the variance of so many numbers with sum s and sum of squares q. square: that of days, if it is there already."""
    if not wide:
        return F.call_function("div", days * q - s * s, days * days if square is None else square) + 1
    d = days.cast("decimal(10,0)")
    above, below = (d * q).cast(WIDE) - (s * s).cast(WIDE), (d * d).cast("decimal(20,0)")
    return ((above - above % below) / below).cast(WIDE) + 1


def _price(days: Column, s: Column, q: Column, wide: bool, square: Column | None = None) -> Column:
    return days * F.floor(F.ln(_spread(days, s, q, wide, square).cast("double")) * 1000.0)


def _path(totals: Column, wide: bool, shortest: int, penalty: int) -> Column:
    """The places where the best segmentation is cut, its ends included: array<struct<end, cost, count, s, q>>.

    A place holds `key`, which is cost, count and start in one number, so that the least key is the choice; `base`, the key of
    segmentations that go on from it, without the cost of their last segment; and the sums up to it."""
    kind, unit = (WIDE, 1 << 31) if wide else ("bigint", 1 << 15)
    big = lambda x: F.lit(str(x)).cast(kind)
    n, one, two, never = F.size(totals), big(unit), big(unit * unit), big(1 << (100 if wide else 61))
    place = lambda key, base, s, q: F.struct(key.cast(kind).alias("key"), base.cast(kind).alias("base"), s.cast(kind).alias("s"), q.cast(kind).alias("q"))

    def step(state: Column, x: Column, lengths: Column) -> Column:
        def best(now: Column) -> Column:
            through = lambda e, d: (e["base"] + (two * _price(d["n"], now["s"] - e["s"], now["q"] - e["q"], wide, d["square"])).cast(kind)).cast(kind)
            far = F.greatest(F.size(state) - shortest + 1, F.lit(0))
            least = F.coalesce(F.array_min(F.zip_with(F.slice(state, shortest, far), F.slice(lengths, shortest, far), through)), never)
            # What goes on from here has a penalty and a segment more, and starts here.
            return _let(least, lambda k: place(k, k - k % one + big(penalty * unit * unit + unit) + now["end"], now["s"], now["q"]))

        x = x.cast(kind)
        now = F.struct(F.size(state).cast(kind).alias("end"), (state[0]["s"] + x).cast(kind).alias("s"), (state[0]["q"] + x * x).cast(kind).alias("q"))
        return F.concat(F.array(_let(now, best)), state)

    def walk(every: Column) -> Column:
        def at(end: Column) -> Column:
            def told(p: Column) -> Column:
                high = F.call_function("div", p["key"], one)
                return F.struct(
                    end.cast("int").alias("end"), F.call_function("div", p["key"], two).cast("long").alias("cost"), (high % unit).cast("long").alias("count"),
                    p["s"].cast(WIDE).alias("s"), p["q"].cast(WIDE).alias("q"), (p["key"] % one).cast("int").alias("start"),
                )

            return _let(F.element_at(every, n + 1 - end), told)

        last = at(n)
        back = F.aggregate(F.sequence(F.lit(1).cast("long"), last["count"]), F.array(last), lambda path, _: F.concat(F.array(at(path[0]["start"])), path))
        return F.transform(back, lambda p: F.struct(*[p[c].alias(c) for c in ("end", "cost", "count", "s", "q")]))

    # The first place is the start; a first segment that is shorter than allowed is never the best.
    # Lengths of segments and their squares are made once a series, as all days ask for them at all places.
    lengths = F.transform(F.sequence(F.lit(1).cast("bigint"), n.cast("bigint")), lambda d: F.struct(d.alias("n"), (d * d).alias("square")))
    return _let(_let(lengths, lambda every: F.aggregate(totals, F.array(place(big(0), one, big(0), big(0))), lambda state, x: step(state, x, every))), walk)


def _whole(totals: Column) -> Column:
    """_path() of a series that can't be cut."""
    n, s = F.size(totals).cast("long"), F.aggregate(totals, F.lit("0").cast(WIDE), lambda a, x: (a + x).cast(WIDE))
    q = F.aggregate(totals, F.lit("0").cast(WIDE), lambda a, x: (a + x.cast(WIDE) * x).cast(WIDE))
    place = lambda end, cost, count, s, q: F.struct(end.cast("int").alias("end"), cost.cast("long").alias("cost"), F.lit(count).cast("long").alias("count"), s.alias("s"), q.alias("q"))
    none = F.lit("0").cast(WIDE)
    return F.array(place(F.lit(0), F.lit(0), 0, none, none), place(n, _price(n, s, q, True), 1, s, q))


def segments(series: DataFrame, shortest: int = SHORTEST, penalty: int = PENALTY) -> DataFrame:
    """(key, first, totals) -> a row a segment: key, segment_no, first_day, n_days, total, spread, cost, n_segments, best_cost."""
    def path(totals: Column) -> Column:
        days, size = F.size(totals), F.aggregate(totals, F.lit(0).cast("double"), lambda a, x: a + F.abs(x).cast("double"))
        fits = (days * size * size < float(1 << 62)) & (days < 1 << 15) & (days.cast("long") * (_MOST + penalty) < 1 << 31)
        return F.when(days < 2 * shortest, _whole(totals)).when(fits, _path(totals, False, shortest, penalty)).otherwise(_path(totals, True, shortest, penalty))

    found = series.select("key", "first", _let(F.col("totals"), path).alias("path"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(i.alias("no"), F.col("path")[i - 1].alias("a"), F.col("path")[i].alias("b")))
    each = found.select("key", "first", F.element_at("path", -1)["count"].alias("n_segments"), F.element_at("path", -1)["cost"].alias("best_cost"), F.explode(pairs).alias("x"))
    days, s, q = F.col("x.b.end") - F.col("x.a.end"), F.col("x.b.s") - F.col("x.a.s"), F.col("x.b.q") - F.col("x.a.q")
    penalties = F.when(F.col("x.no") > 1, penalty).otherwise(0)
    return each.select(
        "key", F.col("x.no").alias("segment_no"), (F.col("first") + F.col("x.a.end")).cast("long").alias("first_day"), days.cast("long").alias("n_days"), s.cast("long").alias("total"),
        _spread(days, s, q, True).cast("long").alias("spread"), (F.col("x.b.cost") - F.col("x.a.cost") - penalties).cast("long").alias("cost"), "n_segments", "best_cost",
    )


def of_vendors(lines: DataFrame) -> DataFrame:
    """The segments of each vendor's daily quantity, of lines that were kept or swapped."""
    taken = lines.where(F.col("flag").isin("kept", "swapped"))
    found = segments(daily(taken, F.col("vendor_id"), F.col("shipped_at"), F.col("quantity")))
    return found.select(F.col("key").alias("vendor_id"), "segment_no", "first_day", "n_days", "total", "spread", "cost", "n_segments", "best_cost")
