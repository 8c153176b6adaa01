"""Chart-data dispatch by chart name, one signature table for every chart kind.

Each entry maps a chart name to the operator that builds the data behind it and the keyword
arguments it needs; arguments are checked against the DataFrame's columns before planning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from txmon.operators import aggregates as agg
from txmon.operators import distribution as dist
from txmon.operators import hierarchy as hier
from txmon.operators import text as txt
from txmon.operators import windows as win

def _xy(df, x_col, y_col, hue_col=None, size_col=None):
    return dist.points(df, [c for c in (x_col, y_col, size_col, hue_col) if c])


def _area(df, x_col=None, y_col=None, category_col=None, value_col=None, order=None):
    """Points of an area chart (x, y), or running totals per category in ``order``."""
    if x_col is not None:
        return dist.points(df, [x_col, y_col])
    return win.cumulative(df, category_col, value_col, order)


# chart name -> (operator, alternatives of required keyword arguments that name columns)
CHARTS = {
    "line_chart": (_xy, [["x_col", "y_col"]]),
    "line_mean_chart": (lambda df, x_col, y_col: agg.line_mean_data(df, x_col, y_col), [["x_col", "y_col"]]),
    "bar_chart": (lambda df, x_col, y_col: agg.bar_data(df, x_col, y_col), [["x_col", "y_col"]]),
    "bar_mean_chart": (lambda df, x_col, y_col, tie=None, max_x=None: agg.bar_mean_data(df, x_col, y_col, max_x, tie), [["x_col", "y_col"]]),
    "scatter_chart": (_xy, [["x_col", "y_col"]]),
    "histogram": (lambda df, x_col=None, col=None, bins=10: dist.histogram(df, x_col or col, bins), [["x_col"], ["col"]]),
    "hbar_chart": (lambda df, values, names, tie=None, n=10, num_bars=None: agg.hbar_data(df, values, names, num_bars or n, tie), [["values", "names"]]),
    "pie_chart": (lambda df, values, names, tie=None, max_categories=None: agg.pie_data(df, names, values, max_categories, tie=tie), [["values", "names"]]),
    "pie_counts": (lambda df, x_col=None, pie_col=None: agg.value_counts(df, x_col or pie_col), [["x_col"], ["pie_col"]]),
    "area_chart": (_area, [["x_col", "y_col"], ["category_col", "value_col"]]),
    "box_plot": (lambda df, x_col, y_col: dist.box_stats(df, x_col, y_col), [["x_col", "y_col"]]),
    "heatmap": (lambda df, x_col, y_col, values, tie=None, num_vals=10: dist.pivot_heatmap(df, x_col, y_col, values, num_vals, tie=tie),
                [["x_col", "y_col", "values"]]),
    "correlation_heatmap": (lambda df, exclude=(), non_numeric_cols=(): dist.corr_matrix(df, exclude or non_numeric_cols), [[]]),
    "bubble_chart": (_xy, [["x_col", "y_col", "size_col"]]),
    "sunburst_chart": (lambda df, path, values: hier.sunburst(df, path, values), [["values"]]),
    "choropleth_map": (lambda df, location_column, color_column, hover_column=None:
                       hier.choropleth(df, location_column, color_column, hover_column),
                       [["location_column", "color_column"]]),
    "kde_plot": (lambda df, x_col=None, hue_col=None, columns=None: dist.kde(df, x_col, hue_col) if x_col else dist.kde_columns(df, columns),
                 [["x_col"], []]),
    "violin_chart": (lambda df, x_col, y_col, color_col=None, box=True, points="all": dist.violin_stats(df, x_col, y_col, color_col),
                     [["x_col", "y_col"]]),
    "violin_outline": (lambda df, x_col, y_col, color_col=None: dist.violin_grid(df, x_col, y_col, color_col), [["x_col", "y_col"]]),
    "funnel_chart": (lambda df, x_col, y_col: hier.funnel(df, y_col, x_col), [["x_col", "y_col"]]),
    "treemap_chart": (lambda df, path, color_col, values_col=None, value_col=None: hier.treemap(df, path, values_col or value_col, color_col),
                      [["values_col", "color_col"], ["value_col", "color_col"]]),
    "density_heatmap": (lambda df, x_col, y_col: dist.density_heatmap(df, x_col, y_col), [["x_col", "y_col"]]),
    "parallel_coordinates": (lambda df, dimensions, color_col: dist.points(df, list(dimensions) + [color_col]), [["color_col"]]),
    "timeline_chart": (lambda df, x_start, x_end, y_col, color_col: dist.points(df, [x_start, x_end, y_col, color_col]),
                       [["x_start", "x_end", "y_col", "color_col"]]),
    "3d_scatter_plot": (lambda df, x_col, y_col, z_col, color_col: dist.points(df, [x_col, y_col, z_col, color_col]),
                        [["x_col", "y_col", "z_col", "color_col"]]),
    "radar_chart": (lambda df, unique_col, aggregated_column, chart_name=None: agg.radar_data(df, unique_col, aggregated_column),
                    [["unique_col", "aggregated_column"]]),
    "wordcloud": (lambda df, text_col=None, text=None, n=None: txt.word_counts(df, text_col or text, n), [["text_col"], ["text"]]),
}
#: Arguments of the drawing, which the data behind a chart do not depend on.
_DRAWING = ("title", "image_filename", "folderpath")


def chart_data(df: DataFrame, kind: str, **kwargs) -> DataFrame:
    """Build the data behind chart ``kind`` (any case); unknown names and missing columns raise ValueError."""
    if kind.lower() not in CHARTS:
        raise ValueError(f"unknown chart kind {kind!r}; known: {sorted(CHARTS)}")
    fn, signatures = CHARTS[kind.lower()]
    kwargs = {k: v for k, v in kwargs.items() if k not in _DRAWING}
    fits = [s for s in signatures if all(a in kwargs for a in s)]
    if not fits:
        raise ValueError(f"{kind} needs {' or '.join(map(str, signatures))}")
    bad = [kwargs[a] for a in fits[0] if kwargs[a] not in df.columns]
    bad += [kwargs[a] for a in ("hue_col", "size_col", "color_col", "hover_column") if kwargs.get(a) is not None and kwargs[a] not in df.columns]
    for p in ("path", "dimensions", "order", "columns"):
        bad += [c for c in kwargs.get(p) or [] if c not in df.columns]
    if bad:
        raise ValueError(f"{kind}: columns not in the data: {bad}")
    return fn(df, **kwargs)
