"""Train / validation / test splits with exact sizes.

The result is one DataFrame with a ``split`` column (``train``/``val``/
``test``); X and y are projections of it.  Membership is decided by a rank
cut: rows are ordered by a key (seeded md5 of the row key for random
splits, time for temporal ones), and the cut ranks per class come from the
scikit-learn size rules.  The values at the cut ranks are found with the exact
order-statistics primitive; a row's split is a comparison with them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DataLoadError
from ..functions import patterns as P
from ..functions.kinds import q
from .ordering import placed, shifted
from .orderstats import group_bounds, select_ranks


def _marked(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("~"))


def seeded_order(keys: list[str], seed: int) -> Column:
    """52-bit order key from md5 of the row key and the seed (the same in DuckDB:
    ``('0x' || left(md5(key || '|' || seed), 13))::BIGINT``)."""
    txt = F.concat_ws("|", *[_marked(F.col(q(k))) for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(txt), 1, 13), 16, 10).cast("long")


def approximate_mode(counts: dict, n_draws: int) -> dict:
    """Largest-remainder allocation of ``n_draws`` over classes in proportion to
    ``counts`` (ties go to classes in sorted order)."""
    total = sum(counts.values())
    if total == 0:
        return {k: 0 for k in counts}
    cont = {k: c * n_draws / total for k, c in counts.items()}
    fl = {k: math.floor(v) for k, v in cont.items()}
    need = n_draws - sum(fl.values())
    for k in sorted(counts, key=lambda k: (-(cont[k] - fl[k]), str(k))):
        if need <= 0:
            break
        fl[k] += 1
        need -= 1
    return fl


def md5_key(cols: list[Column]) -> Column:
    """52-bit key from md5 of the '|'-joined text of ``cols`` (reproducible in SQL); a null is '~'."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[_marked(c) for c in cols])), 1, 13), 16, 10).cast("long")


def rank_below(df: DataFrame, group: Column, order: Column, tiebreak: list[Column], cuts,
               tie_key: Column | None = None) -> DataFrame:
    """Add ``_below_<i>`` booleans: the row's rank within its group (by
    ``order``, then ``tie_key``, then ``tiebreak``) is under the i-th cut of its group.

    ``cuts`` maps group → list of cut ranks, or is a function of the group
    sizes returning that map.  The value at each cut rank comes from the
    order-statistics primitive, and among the rows that share it (perhaps
    a third of all rows, at one timestamp) the same primitive finds the
    ``tie_key`` at the rank that is left (md5 of the tie-break columns by
    default).  A row's flag is then a comparison of its own two values
    with these: a projection, without a sort, a window or a copy of the
    table.  Only rows that share both values with a cut that runs through
    them (rows of one key, or equal ones) are numbered: range-partitioned
    by the tie-break columns, with the sizes of the partitions as offsets,
    so they may be any number as well.
    """
    spark, base = df.sparkSession, df.columns
    key = tie_key if tie_key is not None else md5_key(tiebreak)
    order = order if dict(df.select(order.alias("v")).dtypes)["v"] == "bigint" else order.cast("double")
    d = df.withColumns({"_g": group.cast("string"), "_v": order, "_h": key})
    gv = d.select(F.col("_g").alias("g"), F.col("_v").alias("v")).where(F.col("v").isNotNull())
    bounds = group_bounds(gv)
    if callable(cuts):
        cuts = cuts({g: b[0] for g, b in bounds.items()})
    n_cuts = max((len(c) for c in cuts.values()), default=0)
    asked = [(g, c) for g, cs in cuts.items() for c in cs if g in bounds and 0 <= c < bounds[g][0]]
    values = {(row["g"], row["r"]): row["value"] for row in select_ranks(gv, bounds, asked).collect()} if asked else {}
    kind = dict(gv.dtypes)["v"]

    # one row per group: the value at each cut, and whether the whole group is below it
    at = {(g, i): values.get((g, c)) for g, cs in cuts.items() for i, c in enumerate(cs)}
    whole = {(g, i): g in bounds and c >= bounds[g][0] for g, cs in cuts.items() for i, c in enumerate(cs)}
    each = lambda facts, none=None: [(g, *[facts.get((g, i), none) for i in range(n_cuts)]) for g in cuts]
    known = lambda rows, stem, kind: F.broadcast(spark.createDataFrame(rows, ", ".join(["_g string"] + [f"_{stem}{i} {kind}" for i in range(n_cuts)])))
    x = d.join(known(each(at), "t", kind), "_g", "left").join(known(each(whole, False), "a", "boolean"), "_g", "left")
    col = lambda stem, i: F.col(f"_{stem}{i}")
    sure = lambda c: F.coalesce(c, F.lit(False))
    less = [sure(F.col("_v") < col("t", i)) for i in range(n_cuts)]
    tied = [sure(F.col("_v") == col("t", i)) for i in range(n_cuts)]
    under = {r["_g"]: r for r in x.groupBy("_g").agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(less)]).collect()} if n_cuts else {}
    need = {(g, i): c - under[g][f"n{i}"] for g, cs in cuts.items() for i, c in enumerate(cs) if at[g, i] is not None and c > under[g][f"n{i}"]}

    # among the rows tied with a cut: the key at the rank that is left, and what is left of that
    keys, left = {}, {}
    if need:
        x = x.join(known(each({k: True for k in need}, False), "need", "boolean"), "_g", "left")
        name = lambda i: F.when(tied[i] & col("need", i), F.concat_ws("#", F.col("_g"), F.lit(str(i))))
        ties = x.select(F.explode(F.array(*[name(i) for i in range(n_cuts)])).alias("g"), F.col("_h").alias("v")).where("g IS NOT NULL AND v IS NOT NULL")
        found = select_ranks(ties, group_bounds(ties), [(f"{g}#{i}", k) for (g, i), k in need.items()]).collect()
        names = {f"{g}#{i}": (g, i) for g, i in need}
        keys = {names[r["g"]]: r["value"] for r in found}
        at_key = spark.createDataFrame([(n, keys[k]) for n, k in names.items()], "g string, h long")
        before = {names[r["g"]]: r["n"] for r in ties.join(F.broadcast(at_key), "g").groupBy("g").agg(F.count_if(F.col("v") < F.col("h")).alias("n")).collect()}
        left = {k: n - before[k] for k, n in need.items() if n > before[k]}
    x = x.join(known(each(keys), "h", "long"), "_g", "left").join(known(each(left, 0), "k", "long"), "_g", "left")
    same = [tied[i] & sure(F.col("_h") == col("h", i)) for i in range(n_cuts)]
    flag = lambda i: (sure(col("a", i)) | less[i] | (tied[i] & sure(F.col("_h") < col("h", i))) | (same[i] & sure(F.col("_n") < col("k", i)))).alias(f"_below_{i}")
    cut_through = F.lit(False)
    for i in range(n_cuts):
        cut_through = cut_through | (same[i] & (col("k", i) > 0))
    flags = [flag(i) for i in range(n_cuts)]
    if not left:
        return x.withColumn("_n", F.lit(None).cast("long")).select(*base, *flags)
    plain = x.where(~cut_through).withColumn("_n", F.lit(None).cast("long")).select(*base, *flags)
    names = [f"_tb{i}" for i in range(len(tiebreak))]
    rows, sizes = placed(x.where(cut_through).withColumns(dict(zip(names, tiebreak, strict=True))), [F.col(c) for c in ["_g", "_v", "_h", *names]])
    before, _ = shifted(sizes)
    rows = rows.withColumn("_at", before + F.col("_pos"))
    first = rows.groupBy("_g", "_v", "_h").agg(F.min("_at").alias("_first"))  # a row for each cut at most
    numbered = rows.join(F.broadcast(first), ["_g", "_v", "_h"]).withColumn("_n", F.col("_at") - F.col("_first"))
    return plain.unionByName(numbered.select(*base, *flags))


def split_sizes(n: int, test_size: float, val_size: float) -> tuple[int, int, int]:
    """scikit-learn sizes: test = ⌈n·test⌉, val = ⌈rest·val/(1−test)⌉, train = rest."""
    n_test = math.ceil(test_size * n)
    rest = n - n_test
    n_val = math.ceil(rest * (val_size / (1.0 - test_size))) if val_size > 0 else 0
    return rest - n_val, n_val, n_test


def random_split(df: DataFrame, target: str, *, keys: list[str] | None = None, test_size: float = P.TEST_SIZE,
                 val_size: float = P.VAL_SIZE, stratify: bool = True, seed: int = P.RANDOM_SEED) -> DataFrame:
    """Seeded split with exact sizes (L1); stratified by the target when every
    class has ≥ 2 rows (L2), each stage checked on its own."""
    if target not in df.columns:
        raise DataLoadError(f"Target column '{target}' not found in dataset columns: {df.columns}")
    keys = keys or [c for c in df.columns]
    # one row per class; without strata only the number of rows is wanted (a regression target may have any number of values)
    by = F.col(q(target)).cast("string") if stratify else F.lit("all")
    counts = {row[0]: row[1] for row in df.groupBy(by.alias("k")).count().collect()}
    n = sum(counts.values())
    if n < P.MIN_SPLIT_ROWS:
        raise DataLoadError(f"Dataset has only {n} rows; cannot perform train/test split.")
    n_train, n_val, n_test = split_sizes(n, test_size, val_size)
    order = seeded_order(keys, seed)
    tb = [F.col(q(k)).cast("string") for k in keys]
    strat1 = stratify and all(c >= 2 for c in counts.values())
    if strat1:
        tr_alloc = approximate_mode(counts, n - n_test)
        test_c = {k: counts[k] - tr_alloc[k] for k in counts}
        trainval = {k: tr_alloc[k] for k in counts}
    else:
        test_c = None
        trainval = None
    strat2 = stratify and strat1 and all(c >= 2 for c in trainval.values())
    if strat2:
        n_rest = n - n_test
        tr2 = approximate_mode(trainval, n_rest - n_val)
        val_c = {k: trainval[k] - tr2[k] for k in counts}
        cuts = {k: [test_c[k], test_c[k] + val_c[k]] for k in counts}
        out = rank_below(df, F.col(q(target)), order, tb, cuts)
    elif strat1:
        # stratified test, then a plain val cut among the rest
        out = rank_below(df, F.col(q(target)), order, tb, {k: [test_c[k]] for k in counts})
        out = out.withColumn("_stage", F.when(F.col("_below_0"), "test").otherwise("rest"))
        out = rank_below(out.withColumnRenamed("_below_0", "_b0"), F.col("_stage"), order, tb, {"rest": [n_val]})
        out = out.withColumn("_below_1", F.col("_below_0")).withColumn("_below_0", F.col("_b0")).drop("_b0", "_stage")
        out = out.withColumn("_below_1", F.col("_below_0") | F.col("_below_1"))
    else:
        out = rank_below(df, F.lit("all"), order, tb, {"all": [n_test, n_test + n_val]})
    label = F.when(F.col("_below_0"), "test").when(F.col("_below_1"), "val").otherwise("train")
    return out.withColumn("split", label).drop("_below_0", "_below_1")


def temporal_split(df: DataFrame, target: str, time_column: str, *, test_size: float = P.TEST_SIZE,
                   val_size: float = P.VAL_SIZE, tiebreak: list[str] | None = None) -> DataFrame:
    """Earliest rows train, then val, then test (L3); null times and text that
    is no time sort last.
    n_test = max(1, ⌊n·test⌋), n_val = max(1, ⌊n·val⌋) or 0.  Rows at the
    same time are ordered by md5 of the ``tiebreak`` columns, then by the
    text of all columns."""
    if target not in df.columns:
        raise DataLoadError(f"Target column '{target}' not found in dataset columns: {df.columns}")
    def cuts(sizes: dict) -> dict:
        n = sizes.get("all", 0)
        if n < P.MIN_SPLIT_ROWS:
            raise DataLoadError(f"Dataset has only {n} rows; cannot perform train/test split.")
        n_test = max(1, int(n * test_size))
        n_val = max(1, int(n * val_size)) if val_size > 0 else 0
        return {"all": [n - n_test - n_val, n - n_test]}

    t = F.col(q(time_column))
    kind = dict(df.dtypes)[time_column]
    if kind == "string":
        from .clean import parse_time

        t, kind = parse_time(t, df.schema[time_column].dataType), "timestamp"
    if kind in ("timestamp", "timestamp_ntz", "date"):
        order = F.coalesce(F.unix_micros(t.cast("timestamp")), F.lit((1 << 63) - 1))
    elif kind in ("tinyint", "smallint", "int", "bigint"):
        order = F.coalesce(t.cast("long"), F.lit((1 << 63) - 1))
    else:
        order = F.coalesce(t.cast("double"), F.lit(float("inf")))
    keys = tiebreak or [c for c in df.columns if c != time_column]
    tb = [F.col(q(k)).cast("string") for k in keys] + [F.col(q(k)).cast("string") for k in df.columns if k != time_column and k not in keys]
    out = rank_below(df, F.lit("all"), order, tb, cuts, tie_key=md5_key([F.col(q(k)) for k in keys]))
    label = F.when(F.col("_below_0"), "train").when(F.col("_below_1"), "val").otherwise("test")
    return out.withColumn("split", label).drop("_below_0", "_below_1")


def features_and_target(split_df: DataFrame, target: str, which: str) -> tuple[DataFrame, DataFrame]:
    """X and y of one split (L4)."""
    part = split_df.where(F.col("split") == which)
    return part.drop(target, "split"), part.select(target)
