"""Distribution data behind charts: points, histograms, density grids, box/violin statistics,
kernel density, correlation and the pivot heatmap (A10-A17).

All outputs are bounded by parameters (bins, grid points, groups, columns), not by the input.
Data-dependent constants (min, max, counts) are scalar subqueries: Spark runs them as separate
aggregate jobs and inlines the value, so nothing is collected by hand and no cross join is used.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txmon.operators.segmented import join_on_keys, running_sum
from txmon.operators.topk import top_n


def one_row(stats: DataFrame) -> Column:
    """A one-row DataFrame as a single struct-valued scalar subquery: all its statistics come
    from one job however many fields are read (AQE reuses the identical subquery)."""
    return stats.select(F.struct(*[F.col(c) for c in stats.columns])).scalar()


def _groups(by) -> list[str]:
    return [] if by is None else ([by] if isinstance(by, str) else list(by))


# ------------------------------------------------------------------------------------- A10
def points(df: DataFrame, cols, order=None) -> DataFrame:
    """A10: raw points of line/area/scatter/bubble/3-D/parallel/timeline charts, every row.
    For a bounded plot of many rows use the binned density (A12), which loses none."""
    out = df.select(*([cols] if isinstance(cols, str) else cols))
    return out.orderBy(*([order] if isinstance(order, str) else order)) if order else out


def is_number(x: Column) -> Column:
    """Neither NULL nor NaN: what order statistics are taken over (as the data-frame library does); infinities are values."""
    return x.isNotNull() & ~F.isnan(x)


def is_finite(x: Column) -> Column:
    """Also no infinity: what bins and densities are taken over, as an infinite range has neither width nor spread."""
    return is_number(x) & (F.abs(x) < F.lit(float("inf")))


# ------------------------------------------------------------------------------------- A11
def bucket_expr(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin of x over [lo, hi] (0-based), the maximum falls in the last bin. Where the width or its
    multiple exceeds a double, the bin is taken from halves and shares."""
    width = hi - lo
    inf = F.lit(float("inf"))
    scaled = (x - lo) * F.lit(float(bins))
    share = F.try_divide(x / 2 - lo / 2, hi / 2 - lo / 2) * F.lit(float(bins))
    raw = F.floor(F.when((width < inf) & (scaled < inf), F.try_divide(scaled, width)).otherwise(share))
    return F.when(width == 0, F.lit(0)).otherwise(F.least(raw, F.lit(bins - 1))).cast("int")


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Counts of ``bins`` equal-width bins over [min, max] of the finite values; empty bins reported as 0."""
    x = F.col(col).cast("double")
    vals = df.select(x.alias("_x")).filter(is_finite(F.col("_x")))
    st = one_row(vals.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi")))
    lo, hi = st["lo"], st["hi"]
    counts = (vals.select(bucket_expr(F.col("_x"), lo, hi, bins).alias("bin"))
                  .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = hi / F.lit(float(bins)) - lo / F.lit(float(bins))
    width = F.when(hi - lo < F.lit(float("inf")), (hi - lo) / F.lit(float(bins))).otherwise(width)
    return (spine.join(counts, "bin", "left")
                 .select("bin", (lo + F.col("bin") * width).alias("bin_lo"),
                         (lo + (F.col("bin") + 1) * width).alias("bin_hi"),
                         F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


# ------------------------------------------------------------------------------------- A12
def density_heatmap(df: DataFrame, x: str, y: str, bins_x: int = 10, bins_y: int = 10) -> DataFrame:
    """2-D bin counts plus both marginal histograms in one grouping-sets aggregate, over rows with two finite values.
    ``level`` 0 = cell, 1 = x margin (y_bin NULL), 2 = y margin (x_bin NULL)."""
    v = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")) \
          .filter(is_finite(F.col("_x")) & is_finite(F.col("_y")))
    st = one_row(v.agg(F.min("_x").alias("lx"), F.max("_x").alias("hx"),
                       F.min("_y").alias("ly"), F.max("_y").alias("hy")))
    lx, hx, ly, hy = st["lx"], st["hx"], st["ly"], st["hy"]
    b = v.select(bucket_expr(F.col("_x"), lx, hx, bins_x).alias("x_bin"),
                 bucket_expr(F.col("_y"), ly, hy, bins_y).alias("y_bin"))
    cells = b.groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("_n"))  # then margins from the few cells
    sets = [[F.col("x_bin"), F.col("y_bin")], [F.col("x_bin")], [F.col("y_bin")]]
    return cells.groupingSets(sets, "x_bin", "y_bin").agg(F.sum("_n").alias("count"), F.grouping_id().alias("level"))


# ------------------------------------------------------------------------------- A13, A14
def value_counts_by(df: DataFrame, by, value: str) -> DataFrame:
    """(group..., _v, _c): finite values as DOUBLE with their counts (partial aggregation
    before the shuffle turns a hot group's many rows into its distinct values)."""
    g = _groups(by)
    return (df.select(*g, F.col(value).cast("double").alias("_v")).filter(is_finite(F.col("_v")))
              .groupBy(*g, "_v").agg(F.count(F.lit(1)).alias("_c")))


#: Rank error of the sketch is n / SKETCH; groups of at most SMALL rows are kept whole (off-by-one ranks matter there).
SKETCH = 1000
SMALL = 4 * SKETCH
#: Brackets are sent to every task: at most this many groups have them, the others (under 1 / BRACKETED of all rows each) are kept whole.
BRACKETED = 50_000


def sketched(df: DataFrame, g: list[str], value: str, qs, **more: Column) -> DataFrame:
    """First scan: per group _n, _min, _max, ``more`` aggregates, and for each quantile a bracket (_lo_i, _hi_i) of values that holds
    its ranks. The brackets come from quantile summaries of bounded rank error, asked two errors to either side."""
    around = [p for q in qs for p in (max(0.0, q - 2 / SKETCH), min(1.0, q + 2 / SKETCH))]
    v = df.withColumn("_v", F.col(value).cast("double")).filter(is_number(F.col("_v")))
    st = v.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
                           F.percentile_approx("_v", around, SKETCH).alias("_p"), *[c.alias(n) for n, c in more.items()])
    small = F.col("_n") <= SMALL
    st = st.withColumns({f"_{side}_{i}": F.when(small, F.col(f"_{bound}")).otherwise(F.col("_p")[2 * i + k])
                         for i, _ in enumerate(qs) for k, (side, bound) in enumerate((("lo", "min"), ("hi", "max")))})
    return st.drop("_p")


def bracketed(df: DataFrame, g: list[str], value: str, qs, st: DataFrame) -> DataFrame:
    """Second scan: (group..., _v, _out, _c). Rows inside a bracket keep their value; all others are only counted, at the
    bracket end below them (_out = 1), so what is shuffled is a few counts and the brackets' distinct values.

    The rows meet their brackets where they are read: a shuffle on the group would bring a hot group's rows to one task."""
    v = df.select(*g, F.col(value).cast("double").alias("_v")).filter(is_number(F.col("_v")))
    los, his = [F.col(f"_lo_{i}") for i, _ in enumerate(qs)], [F.col(f"_hi_{i}") for i, _ in enumerate(qs)]
    total = st.select(F.sum("_n")).scalar()
    wide = st.filter((F.col("_n") > SMALL) & (F.col("_n") > total / BRACKETED))
    rows = join_on_keys(v, F.broadcast(wide.select(*g, "_min", *[f"_{s}_{i}" for i, _ in enumerate(qs) for s in ("lo", "hi")])), g)
    inside = reduce(lambda a, b: a | b, [(lo <= F.col("_v")) & (F.col("_v") <= hi) for lo, hi in zip(los, his)])
    inside = F.coalesce(inside, F.lit(True))  # no bracket: a group that is kept whole
    below = F.greatest(F.col("_min"), F.col("_min"), *[F.when(hi < F.col("_v"), hi) for hi in his])
    return (rows.select(*g, F.when(inside, F.col("_v")).otherwise(below).alias("_v"), (~inside).cast("int").alias("_out"))
                .groupBy(*g, "_v", "_out").agg(F.count(F.lit(1)).alias("_c")))


def exact_quantiles(df: DataFrame, by, value: str, qs=(0.25, 0.5, 0.75), st: DataFrame | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per group (pandas ``quantile`` / SQL
    ``percentile_cont``), one row per (group, q) with ``quantile``. Infinities are values; between two equal ones lies the same.

    1. one scan brackets each quantile (``sketched``; pass ``st`` to share it);
    2. one scan counts the rows outside the brackets and keeps the distinct values inside (``bracketed``);
    3. cumulative count per group in value order -- skew-safe segmented running sum over that small table;
    4. keep the few (group, value) rows that hold the target ranks floor/ceil(q*(n-1)),
       joined on the group with the per-group targets (AQE splits a hot group), and interpolate.

    A target rank outside its bracket would contradict the summary's error bound; it raises instead of giving a wrong value.
    """
    g = _groups(by)
    if not g:  # one implicit group: a constant key keeps every join an equi-join
        st0 = None if st is None else st.withColumn("_all", F.lit(0))
        return exact_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, qs, st0).drop("_all")
    if st is None:
        st = sketched(df, g, value, qs)
    cum = running_sum(bracketed(df, g, value, qs, st), g, ["_v", "_out"], "_c", "_cum")
    qarr = F.array(*[F.lit(float(q)) for q in qs])
    targets = (st.select(*g, F.col("_n"), F.explode(qarr).alias("q"))
                .withColumn("_pos", F.col("q") * (F.col("_n") - 1))
                .withColumn("_rlo", F.floor("_pos")).withColumn("_rhi", F.ceil("_pos")))

    def covers(r: str) -> Column:
        return (F.col("_cum") - F.col("_c") <= F.col(r)) & (F.col(r) < F.col("_cum"))

    hit = join_on_keys(cum, targets, g, "inner", covers("_rlo") | covers("_rhi"))
    known = F.when(F.col("_out") == 0, F.col("_v")).otherwise(F.raise_error(F.lit("quantile outside its bracket")).cast("double"))
    hit = hit.select(*g, "q", "_pos", "_rlo", known.alias("_v"), covers("_rlo").alias("_is_lo"), covers("_rhi").alias("_is_hi"))
    res = hit.groupBy(*g, "q").agg(F.max(F.when(F.col("_is_lo"), F.col("_v"))).alias("_lo"),
                                   F.max(F.when(F.col("_is_hi"), F.col("_v"))).alias("_hi"),
                                   F.first("_pos").alias("_pos"), F.first("_rlo").alias("_rlo"))
    frac = F.col("_pos") - F.col("_rlo")
    between = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac
    return res.select(*g, "q", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(between).alias("quantile"))


def _quantile_columns(df: DataFrame, by, value: str, qs, names, approx: bool, accuracy: int,
                      st: DataFrame | None = None) -> DataFrame:
    g = _groups(by)
    if approx:
        arr = F.percentile_approx(F.col(value).cast("double"), [float(q) for q in qs], accuracy)
        return df.groupBy(*g).agg(arr.alias("_qs")).select(*g, *[F.col("_qs")[i].alias(nm) for i, nm in enumerate(names)])
    long = exact_quantiles(df, g, value, qs, st)
    return long.groupBy(*g).agg(*[F.max(F.when(F.col("q") == float(q), F.col("quantile"))).alias(nm)
                                  for q, nm in zip(qs, names)])


#: Quantiles of box and violin plots.
QUARTILES, QUARTILE_NAMES = (0.25, 0.5, 0.75), ["q1", "median", "q3"]


def attach(a: DataFrame, b: DataFrame, g: list[str]) -> DataFrame:
    """Add the columns of ``b`` (one row per group) to the rows of ``a``.

    With groups: a null-safe equi-join (``b`` is small; AQE broadcasts it from its runtime size
    or splits a hot group's partition). Without groups ``b`` is one row: its columns become
    scalar subqueries, so no join at all."""
    extra = [c for c in b.columns if c not in g]
    if not g:
        row = one_row(b.select(*extra))
        return a.withColumns({c: row[c] for c in extra})
    return join_on_keys(a, b, g, "inner")


def box_stats(df: DataFrame, x, y: str, approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Per group of ``x``: q1, median, q3, iqr, min, max, n (exact unless ``approx``): two scans and a small shuffle."""
    g = _groups(x)
    if approx:
        q = _quantile_columns(df, g, y, QUARTILES, QUARTILE_NAMES, True, accuracy)
        mm = df.groupBy(*g).agg(F.min(F.col(y).cast("double")).alias("min"),
                                F.max(F.col(y).cast("double")).alias("max"), F.count(y).alias("n"))
    else:
        # min, max and n come from the scan that brackets the quantiles
        st = sketched(df, g, y, QUARTILES)
        q = _quantile_columns(df, g, y, QUARTILES, QUARTILE_NAMES, False, accuracy, st)
        mm = st.select(*g, F.col("_min").alias("min"), F.col("_max").alias("max"), F.col("_n").alias("n"))
    out = attach(mm, q, g)
    return out.withColumn("iqr", F.when(F.col("q3") == F.col("q1"), F.lit(0.0)).otherwise(F.col("q3") - F.col("q1")))


def violin_stats(df: DataFrame, x, y: str, color: str | None = None, approx: bool = False,
                 accuracy: int = 10000) -> DataFrame:
    """Per group (and colour group): mean, median, q1, q3, n."""
    g = _groups(x) + ([color] if color else [])
    exact = isinstance(df.schema[y].dataType, T.DecimalType)  # money sums stay exact
    total = F.sum(F.col(y) if exact else F.col(y).cast("double"))
    if approx:
        v = df.filter(is_number(F.col(y).cast("double")))
        q = _quantile_columns(v, g, y, QUARTILES, QUARTILE_NAMES, True, accuracy)
        m = v.groupBy(*g).agg((F.sum(y).cast("double") / F.count(y)).alias("mean"), F.count(y).alias("n"))
        return attach(m, q, g)
    # mean and n come from the scan that brackets the quantiles
    st = sketched(df, g, y, QUARTILES, _total=total.cast("double"))
    q = _quantile_columns(df, g, y, QUARTILES, QUARTILE_NAMES, False, accuracy, st)
    m = st.select(*g, (F.col("_total") / F.col("_n")).alias("mean"), F.col("_n").alias("n"))
    return attach(m, q, g)


def violin_grid(df: DataFrame, x, y: str, color: str | None = None, grid: int = 100, cut: float = 2.0, bins: int = 1000) -> DataFrame:
    """The outline of each violin: a kernel density per group on a grid from min - cut*bw to max + cut*bw.
    Every group's area is 1 (violins are scaled by the plot, not by the group's share)."""
    return kde(df, y, by=_groups(x) + ([color] if color else []), grid=grid, cut=cut, common_norm=False, bins=bins)


# ------------------------------------------------------------------------------------- A15
def kde(df: DataFrame, col: str, by=None, grid: int = 200, cut: float = 3.0,
        common_norm: bool = True, bins: int | None = 1000) -> DataFrame:
    """Gaussian kernel density on a grid, per group.

    Bandwidth is Scott's rule, ``sd * n^(-1/5)`` (sd with ddof 1); the grid spans
    [min - cut*bw, max + cut*bw] with ``grid`` points per group. With ``common_norm`` the groups
    share one total area (each density is scaled by n_group / n_total). Groups without spread (one
    value, or one row) have no density and are left out.

    The data are compressed once to (group, value, count); statistics, total and kernels all come from
    that table. By default its values are collapsed into ``bins`` equal-width bins per group and the
    kernel is evaluated at the bin centres weighted by count: bounded work. ``bins=None`` evaluates every
    distinct value exactly (distinct values x grid, reduced by partial aggregation before the shuffle).
    """
    g = _groups(by)
    vc = value_counts_by(df, g, col)
    w, v = F.col("_c").cast("double"), F.col("_v")
    centre = one_row(vc.agg(F.min("_v").alias("at")))["at"]  # shifted squares: no cancellation
    st = vc.groupBy(*g).agg(F.sum("_c").alias("_n"), F.sum(w * (v - centre)).alias("_s1"), F.sum(w * (v - centre) * (v - centre)).alias("_s2"),
                            F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    n = F.col("_n").cast("double")
    st = st.withColumn("_sd", F.sqrt(F.greatest(F.try_divide(F.col("_s2") - F.col("_s1") * F.col("_s1") / n, n - 1), F.lit(0.0))))
    total = st.select(F.sum("_n")).scalar()
    st = (st.filter("_max > _min AND _sd > 0").withColumn("_bw", F.col("_sd") * F.pow(n, F.lit(-0.2)))
            .withColumn("_glo", F.col("_min") - F.lit(cut) * F.col("_bw"))
            .withColumn("_step", (F.col("_max") + F.lit(cut) * F.col("_bw") - F.col("_glo")) / F.lit(float(grid - 1)))
            .withColumn("_scale", (F.col("_n") / total) if common_norm else F.lit(1.0)).drop("_s1", "_s2", "_sd"))
    pts = attach(vc, st, g)
    if not g:
        pts = pts.filter(F.col("_bw").isNotNull())
    if bins:
        width = (F.col("_max") - F.col("_min")) / F.lit(float(bins))
        pts = (pts.withColumn("_b", bucket_expr(F.col("_v"), F.col("_min"), F.col("_max"), bins))
                  .groupBy(*g, "_b", "_n", "_bw", "_glo", "_step", "_scale", "_min", "_max")
                  .agg(F.sum("_c").alias("_c"))
                  .withColumn("_v", F.col("_min") + (F.col("_b") + F.lit(0.5)) * width))
    # grid index rows first, then plain column arithmetic: generate, kernel and the partial
    # aggregate stay in one whole-stage-codegen span (no interpreted lambda per element)
    ex = pts.select(*g, "_v", w.alias("_w"), "_bw", "_glo", "_step",
                    F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("grid_index"))
    z = (F.col("_glo") + F.col("grid_index") * F.col("_step") - F.col("_v")) / F.col("_bw")
    sums = ex.groupBy(*g, "grid_index").agg(F.sum(F.col("_w") * F.exp(F.lit(-0.5) * z * z)).alias("_ksum"))
    dens = attach(sums, st.select(*g, "_n", "_bw", "_glo", "_step", "_scale"), g)
    norm = F.col("_n") * F.col("_bw") * F.lit(math.sqrt(2 * math.pi))
    return dens.select(*g, "grid_index", (F.col("_glo") + F.col("grid_index") * F.col("_step")).alias("x"),
                       (F.col("_ksum") / norm * F.col("_scale")).alias("density"))


def kde_columns(df: DataFrame, columns, grid: int = 200, cut: float = 3.0, bins: int | None = 1000) -> DataFrame:
    """One curve per numeric column (``series``), each with area 1."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("value")) for c in columns])).alias("s"))
    return kde(long.select("s.series", "s.value"), "value", "series", grid, cut, common_norm=False, bins=bins)


def density_histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """The histogram drawn under a density curve: counts scaled to a total area of 1."""
    h = histogram(df, col, bins)
    total = h.select(F.sum("count")).scalar()
    return h.withColumn("density", F.try_divide(F.col("count").cast("double"), total * (F.col("bin_hi") - F.col("bin_lo"))))


# ------------------------------------------------------------------------------------- A16
def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)]


def _corr(a: Column, b: Column) -> Column:
    """Pearson correlation over the rows that have both values; NULL where one of them does not vary."""
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def corr_matrix(df: DataFrame, exclude=(), columns=None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns (pairwise-complete), long form
    (col_a, col_b, corr) including the diagonal. An ``exclude`` name that is not a column yields
    an empty result, as the report does."""
    spark = df.sparkSession
    schema = "col_a string, col_b string, corr double"
    if any(c not in df.columns for c in exclude):
        return spark.createDataFrame([], schema)
    cols = list(columns) if columns else numeric_columns(df, exclude)
    # Pearson is symmetric: aggregate each unordered pair once (i <= j), emit both orders
    cell = {(i, j): f"c{i}_{j}" for i in range(len(cols)) for j in range(i, len(cols))}
    aggs = [_corr(F.col(cols[i]).cast("double"), F.col(cols[j]).cast("double")).alias(name)
            for (i, j), name in cell.items()]
    wide = df.agg(*aggs)
    structs = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(cell[min(i, j), max(i, j)]).alias("corr"))
               for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


# ------------------------------------------------------------------------------------- A17
def pivot_heatmap(df: DataFrame, x: str, y: str, values: str, n: int = 10, tie: str | None = None) -> DataFrame:
    """Top-n rows by value; every pair of their x and y values with the mean of duplicates and 0 for
    gaps, in long form (x, y, value). A missing x or y is a value of its own. At most n rows reach the pairs."""
    top = top_n(df, n, values, tie or x).select(F.col(x).alias("_x"), F.col(y).cast("string").alias("_y"), F.col(values).cast("double").alias("_v"))
    cells = top.groupBy("_x", "_y").agg(F.avg("_v").alias("_v"))
    ys = cells.select(F.sort_array(F.collect_set(F.struct("_y")))).scalar()  # at most n values
    grid = cells.select("_x").distinct().select("_x", F.explode(ys).alias("_s")).select("_x", F.col("_s._y").alias("_y"))
    out = join_on_keys(grid, cells, ["_x", "_y"])
    return out.select(F.col("_x").alias(x), F.col("_y").alias(y), F.coalesce("_v", F.lit(0.0)).alias("value"))
