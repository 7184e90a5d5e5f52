"""A static page of routes, made of column functions."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STYLE = "body{font:14px sans-serif;max-width:60em;margin:2em auto}h2{margin-top:2em}li{margin:.2em 0}.leaf{color:#555}"


def escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def section(row_target: Column, route: Column, n_steps: Column, steps: Column, leaves: Column) -> Column:
    """A route: its target, its steps in order and its leaves."""
    items = F.array_join(F.transform(steps, lambda s: F.concat(F.lit("<li>"), escaped(s), F.lit("</li>"))), "")
    ends = F.array_join(F.transform(leaves, escaped), ", ")
    head = F.concat(F.lit("<h2>"), escaped(row_target), F.lit("</h2><p>route "), route.cast("string"), F.lit(", "), n_steps.cast("string"), F.lit(" steps</p>"))
    return F.concat(head, F.lit("<ol>"), items, F.lit('</ol><p class="leaf">'), ends, F.lit("</p>"))


def write_page(routes: DataFrame, path: str, title: str) -> None:
    """One HTML file from (target, route, n_steps, steps, leaves), ordered by target and route; for a report's size."""
    body = routes.select("target", "route", F.lit(1).alias("part"), section(F.col("target"), F.col("route"), F.col("n_steps"), F.col("steps"), F.col("leaves")).alias("value"))
    first = f"<!doctype html><html><head><meta charset=\"utf-8\"><title>{html.escape(title)}</title><style>{STYLE}</style></head><body><h1>{html.escape(title)}</h1>"
    ends = routes.sparkSession.createDataFrame([("", 0, 0, first), ("", 0, 2, "</body></html>")], "target string, route int, part int, value string")
    body.unionByName(ends).repartition(1).sortWithinPartitions("part", "target", "route").select("value").write.mode("overwrite").text(path)
