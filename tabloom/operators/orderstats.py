"""Exact order statistics (k-th smallest value per group) that scale.

Spark's exact ``percentile`` keeps every distinct value of a group in one
hash map and merges them in one task, so a global median of a 10^12-row
column cannot finish.  Here each target ``(group, rank)`` keeps an interval
``[lo, hi]`` known to hold its answer, and the count ``below`` of the
group's values under ``lo``.  A refinement level is one aggregation job:
values inside an active interval are put in 2048 buckets, counted per
(target, bucket) with map-side combine, and the bucket holding the rank
becomes the new, tighter interval (its own min/max).  Once an interval holds
at most ``exact_rows`` values, the answer is read off a sort of just those
values (one window task per interval, bounded by ``exact_rows``).

The number of levels is fixed by the type, not by the data:

* integers, dates, timestamps and decimals of up to 18 digits are compared
  as 64-bit integers and bucketed by their leading bits, 11 a level: six
  levels at most;
* longer decimals are two such integers, the second one ranked among the
  values that share the first;
* doubles are bucketed by equal width; where that leaves too many, by the
  exponent and leading bits (equal width of the logarithm) until an
  interval spans less than a factor of two, from where on each level of
  equal width resolves 11 more of the 53 bits: nine levels at most.

No value of an integer or decimal column passes through a double.  A hot
value (one value repeated for a third of the rows) collapses an interval to
``lo == hi``, which answers the target at once.  The driver only sees one
row per target (group, rank, interval, counts).
"""

from __future__ import annotations

import math
from decimal import Decimal, localcontext
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 2048
EXACT_ROWS = 1_000_000
#: Equal width, logarithm.
LINEAR, LOG = 0, 1


def _schema(kind: str) -> str:
    return f"tid long, g string, r long, lo {kind}, hi {kind}, below long, m long, how int"


def group_bounds(d: DataFrame) -> dict:
    """``{group: (n, min, max)}`` for ``d(g, v)`` — one row per group."""
    rows = d.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    return {row["g"]: (row["n"], row["lo"], row["hi"]) for row in rows}


def _prepare(data: DataFrame, group: str, value: str) -> DataFrame:
    kind = "long" if dict(data.dtypes)[value] in ("tinyint", "smallint", "int", "bigint") else "double"
    return data.select(F.col(group).cast("string").alias("g"), F.col(value).cast(kind).alias("v")).where(F.col("v").isNotNull())


def _how(lo, hi, last: int | None, buckets: int) -> int:
    """How to bucket an interval: integers by a shift, doubles by equal width or by their logarithm.

    The shift is the least that leaves fewer than ``buckets`` steps between
    the ends.  The logarithm follows a level of equal width if the interval
    still spans a factor of two.
    """
    if isinstance(lo, int):
        return next(s for s in range(64) if (hi >> s) - (lo >> s) < buckets)
    if float("inf") in (abs(lo), abs(hi)):
        return LINEAR
    wide = lo <= 0 <= hi or max(abs(lo), abs(hi)) > 2 * min(abs(lo), abs(hi))
    return LOG if wide and (last is not None or hi - lo == float("inf")) else LINEAR


def select_ranks(d: DataFrame, bounds: dict, targets: list[tuple], *, exact_rows: int = EXACT_ROWS, buckets: int = BUCKETS) -> DataFrame:
    """``(g, r, value)`` for ``targets = [(g, r), ...]`` over ``d(g string, v long or double)``."""
    spark = d.sparkSession
    kind = "long" if dict(d.dtypes)["v"] == "bigint" else "double"
    typed = int if kind == "long" else float
    state = []
    for i, (g, r) in enumerate(sorted(set(targets))):
        n, lo, hi = bounds[g]
        if 0 <= r < n:
            state.append((i, g, int(r), typed(lo), typed(hi), 0, int(n), _how(typed(lo), typed(hi), None, buckets)))
    open_ = lambda s: s[6] > exact_rows and s[3] < s[4]
    active, done = [s for s in state if open_(s)], [s for s in state if not open_(s)]
    while active:
        refined = [tuple(x) for x in _refine(d, spark.createDataFrame(active, _schema(kind)), buckets, kind).collect()]
        refined = [(*x[:7], _how(x[3], x[4], x[7], buckets)) for x in refined]
        active = [s for s in refined if open_(s)]
        done += [s for s in refined if not open_(s)]

    point = [(s[1], s[2], s[3]) for s in done if s[3] == s[4]]
    rest = [s for s in done if s[3] < s[4]]
    result = spark.createDataFrame(point, f"g string, r long, value {kind}")
    if rest:
        # Targets of one group that share an interval share one sort.
        ivs = {}
        for s in rest:
            ivs.setdefault((s[1], s[3], s[4], s[5]), len(ivs))
        iv_df = spark.createDataFrame([(*k, i) for k, i in ivs.items()], f"g string, lo {kind}, hi {kind}, below long, iid long")
        tg_df = spark.createDataFrame([(ivs[(s[1], s[3], s[4], s[5])], s[1], s[2]) for s in rest], "iid long, g string, r long")
        inside = d.join(F.broadcast(iv_df), "g").where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        w = Window.partitionBy("iid").orderBy("v")
        ranked = inside.select("iid", "v", (F.row_number().over(w) - 1 + F.col("below")).alias("r"))
        picked = ranked.join(F.broadcast(tg_df), ["iid", "r"]).select("g", "r", F.col("v").alias("value"))
        result = result.unionByName(picked)
    return result


def order_statistics(data: DataFrame, targets: DataFrame, *, group: str = "g", value: str = "v", **kw) -> DataFrame:
    """``(group, r, value)``: the r-th smallest (0-based) value of each group.

    ``data`` holds ``(group, value)``; ``targets`` holds ``(group, r)``, one
    row per wanted rank (a small table: a few ranks per group).
    """
    d = _prepare(data, group, value)
    bounds = group_bounds(d)
    tg = [(str(row[0]), int(row[1])) for row in targets.select(F.col(group).cast("string"), "r").collect()]
    return select_ranks(d, bounds, tg, **kw).withColumnRenamed("g", group)


def _double_bucket(buckets: int) -> Column:
    """Bucket of ``v`` in ``[lo, hi]``: never less for a greater value."""
    lo, hi, v = F.col("lo"), F.col("hi"), F.col("v")
    # the logarithm of a value with the sign kept: 0 is at 0, the least positive double at 1
    scale = lambda x: F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1075.0))
    log, a, b = F.col("how") == LOG, scale(lo), scale(hi)
    place = F.when(log, (scale(v) - a) / ((b - a) / buckets)).otherwise((v - lo) / ((hi - lo) / buckets))
    infinite_edge = (F.abs(lo) == float("inf")) | (F.abs(hi) == float("inf"))
    inner = F.when(infinite_edge, F.lit(1)).otherwise(F.least(F.greatest(F.floor(F.nanvl(place, F.lit(0.0))), F.lit(0)), F.lit(buckets - 1)))
    return F.when(v == lo, F.lit(0)).when(v == hi, F.lit(buckets - 1)).otherwise(inner).cast("int")


def _refine(d: DataFrame, active: DataFrame, buckets: int, kind: str) -> DataFrame:
    lo, hi, v = F.col("lo"), F.col("hi"), F.col("v")
    bucket = F.expr("CAST(shiftright(v, how) - shiftright(lo, how) AS INT)") if kind == "long" else _double_bucket(buckets)
    inside = d.join(F.broadcast(active.select("tid", "g", "lo", "hi", "how")), "g").where((v >= lo) & (v <= hi))
    counts = inside.groupBy("tid", bucket.alias("b")).agg(
        F.count(F.lit(1)).alias("c"), F.min("v").alias("bmin"), F.max("v").alias("bmax")
    )
    w = Window.partitionBy("tid").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    cum = counts.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
    return (
        cum.join(F.broadcast(active.select("tid", "g", "r", "below", "how")), "tid")
        .where((F.col("below") + F.col("before") <= F.col("r")) & (F.col("r") < F.col("below") + F.col("before") + F.col("c")))
        .select(
            "tid",
            "g",
            "r",
            F.col("bmin").alias("lo"),
            F.col("bmax").alias("hi"),
            (F.col("below") + F.col("before")).alias("below"),
            F.col("c").alias("m"),
            "how",
        )
    )


def quantiles_long(long: DataFrame, probs: list[float], *, group: str = "g", value: str = "v", **kw) -> DataFrame:
    """Linear-interpolated quantiles per group (the pandas / ``quantile_cont`` rule).

    ``long`` holds ``(group, value)``; nulls are ignored.  Returns
    ``(group, p, value)``; groups without values are absent.
    """
    d = _prepare(long, group, value)
    bounds = group_bounds(d)
    plan = []
    targets = []
    for g, (n, _, _) in bounds.items():
        for p in probs:
            pos = float(p) * (n - 1)
            lo_r, hi_r = int(pos // 1), int(-((-pos) // 1))
            plan.append((g, float(p), pos, lo_r, hi_r))
            targets += [(g, lo_r), (g, hi_r)]
    spark = long.sparkSession
    if not plan:
        return spark.createDataFrame([], f"{group} string, p double, value double")
    stats = select_ranks(d, bounds, targets, **kw)
    pos = spark.createDataFrame(plan, "g string, p double, pos double, r_lo long, r_hi long")
    a = stats.select("g", F.col("r").alias("r_lo"), F.col("value").alias("a"))
    b = stats.select("g", F.col("r").alias("r_hi"), F.col("value").alias("b"))
    return (
        pos.join(a, ["g", "r_lo"])
        .join(b, ["g", "r_hi"])
        .select(
            F.col("g").alias(group),
            "p",
            (F.col("a") + (F.col("b") - F.col("a")) * (F.col("pos") - F.col("r_lo"))).alias("value"),
        )
    )


def approx_quantiles_long(long: DataFrame, probs: list[float], *, group: str = "g", value: str = "v", accuracy: int = 10000) -> DataFrame:
    """Approximate quantiles per group (``percentile_approx``), for the explicit approximate mode."""
    d = _prepare(long, group, value)
    arr = F.array(*[F.lit(float(p)) for p in probs])
    agg = d.groupBy("g").agg(F.percentile_approx("v", arr, accuracy).alias("qs"))
    return agg.select(F.col("g").alias(group), F.posexplode("qs").alias("i", "value")).select(
        group, F.element_at(arr, F.col("i") + 1).alias("p"), "value"
    )


def _integers(c: Column, kind: T.DataType) -> Column | None:
    """64-bit integers that order as the values of ``c`` do, if its type has them."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (c * F.lit(Decimal(10) ** kind.scale)).cast("decimal(38,0)").cast("long")
    return None


def _decimal_ranks(d: DataFrame, ranks: dict[str, int], **kw) -> dict[str, Decimal]:
    """Value at one rank of each group of ``d(g, v decimal)``.

    A decimal's nearest double orders as the decimals do, up to equality;
    decimals with the same double are told apart by what they are above the
    least of them.  Each step resolves 53 bits, so three steps always do.
    """
    near = d.select("g", "v", F.col("v").cast("double").alias("x"))
    doubles = near.select("g", F.col("x").alias("v"))
    bounds = group_bounds(doubles)
    asked = [(g, r) for g, r in ranks.items() if g in bounds]
    found = {row["g"]: row["value"] for row in select_ranks(doubles, bounds, asked, **kw).collect()}
    at = d.sparkSession.createDataFrame([(g, x) for g, x in found.items()], "g string, at double")
    both = near.join(F.broadcast(at), "g")
    here = F.when(F.col("x") == F.col("at"), F.col("v"))
    facts = both.groupBy("g").agg(F.count_if(F.col("x") < F.col("at")).alias("below"), F.min(here).alias("lo"), F.max(here).alias("hi")).collect()
    out = {f["g"]: f["lo"] for f in facts}
    left = {f["g"]: ranks[f["g"]] - f["below"] for f in facts if f["lo"] != f["hi"]}
    if left:
        least = d.sparkSession.createDataFrame([(f["g"], f["lo"]) for f in facts if f["g"] in left], f"g string, lo {dict(d.dtypes)['v']}")
        rest = both.where(F.col("x") == F.col("at")).join(F.broadcast(least), "g").select("g", (F.col("v") - F.col("lo")).cast(d.schema["v"].dataType).alias("v"))
        with localcontext() as ctx:
            ctx.prec = 80
            out |= {g: out[g] + more for g, more in _decimal_ranks(rest, left, **kw).items()}
    return out


def typed_quantiles(df: DataFrame, column: str, probs: list[float], **kw) -> DataFrame:
    """``(p, value)``: linear-interpolated quantiles of one column, in a type that holds them exactly.

    Integers and decimals give a decimal with up to six digits more (half
    even beyond), dates and timestamps a timestamp (whole microseconds,
    rounded down), other numbers a double.  Nulls and NaN are ignored; a
    column without values gives no rows.
    """
    from ..functions.kinds import q

    spark, kind = df.sparkSession, df.schema[column].dataType
    c = F.col(q(column))
    whole = _integers(c, kind)
    if whole is None and not isinstance(kind, T.DecimalType):
        value = F.when(~F.isnan(c.cast("double")), c.cast("double"))
        return quantiles_long(df.select(F.lit("all").alias("g"), value.alias("v")), probs, **kw).select("p", "value")
    long = df.select(F.lit("all").alias("g"), (c if whole is None else whole).alias("v")).where(F.col("v").isNotNull())
    bounds = group_bounds(long)
    if not bounds:
        n = 0
    else:
        n = bounds["all"][0]
    places = {p: Fraction(str(p)) * (n - 1) for p in probs} if n else {}
    wanted = sorted({r for x in places.values() for r in (math.floor(x), math.ceil(x))})
    scale, digits = (kind.scale, kind.precision) if isinstance(kind, T.DecimalType) else (0, 19)
    if whole is not None:
        unit = Decimal(1).scaleb(-scale)
        got = {row["r"]: row["value"] * unit for row in select_ranks(long, bounds, [("all", r) for r in wanted], **kw).collect()} if n else {}
    else:
        got = {}
        if n:
            several = long.select(F.explode(F.array(*[F.lit(str(r)) for r in wanted])).alias("g"), "v")
            got = {int(g): v for g, v in _decimal_ranks(several, {str(r): r for r in wanted}, **kw).items()}
    rows = []
    with localcontext() as ctx:
        ctx.prec = 80
        for p, x in places.items():
            a, b, part = got[math.floor(x)], got[math.ceil(x)], x - math.floor(x)
            rows.append((float(p), a + (b - a) * part.numerator / part.denominator))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        per = 86_400_000_000 if isinstance(kind, T.DateType) else 1
        micros = spark.createDataFrame([(p, math.floor(v * per)) for p, v in rows], "p double, value long")
        return micros.select("p", F.timestamp_micros("value").alias("value"))
    out = min(scale + 6, 38 - (digits - scale))
    step = Decimal(1).scaleb(-out)
    with localcontext() as ctx:
        ctx.prec = 80
        rows = [(p, v.quantize(step)) for p, v in rows]
    return spark.createDataFrame(rows, T.StructType([T.StructField("p", T.DoubleType()), T.StructField("value", T.DecimalType(38, out))]))
