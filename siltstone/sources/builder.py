"""Page-builder trees with the templates that they name put in their place."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Templates within templates.
TEMPLATE_DEPTH = 3
_PIECES = "tree_id long, at int, text string, template long"


def template_of(node: dict) -> int:
    """The template that a node stands for; 0 for none."""
    if node.get("elType") != "template" and node.get("widgetType") != "global":
        return 0
    settings = node.get("settings")
    settings = settings if isinstance(settings, dict) else {}
    named = [settings.get("templateID"), settings.get("template_id"), node.get("templateID")]
    named = [x.get("value") if isinstance(x, dict) and "$$type" in x else x for x in named]
    return next((int(x) for x in named if not isinstance(x, bool) and re.fullmatch(r"[1-9]\d*", str(x))), 0)


def tree_pieces(tree: str | None, depth: int = 64) -> Iterator[tuple[str | None, int | None]]:
    """Texts and templates of a tree in order. Texts are longer than 25 characters and no URLs, short codes or style rules."""
    try:
        waiting = [(json.loads(tree), 0)]
    except (TypeError, ValueError):
        return
    while waiting:
        node, level = waiting.pop()
        if level > depth:
            continue
        if isinstance(node, dict) and "$$type" in node:
            waiting.append((node.get("value"), level + 1))
        elif isinstance(node, dict) and (node.get("elType") == "template" or node.get("widgetType") == "global"):
            waiting.append((node.get("elements"), level + 1))
            if template := template_of(node):
                yield None, template
        elif isinstance(node, dict | list):
            below = list(node.values() if isinstance(node, dict) else node)
            waiting += [(x, level + 1) for x in reversed(below)]
        elif isinstance(node, str):
            text = " ".join(re.sub(r"<[^>]+>", " ", node).split())
            if len(text) > 25 and not re.match(r"https?://|\[\w+|[.#]?[\w\-]+\s*\{", text):
                yield text, None


def pieces(trees: DataFrame) -> DataFrame:
    """``tree_id``, ``at``, ``text``, ``template`` of ``tree_id``, ``tree`` (JSON): a row for each text and each template, numbered in order."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, at, *piece) for i, tree in zip(frame["tree_id"], frame["tree"]) for at, piece in enumerate(tree_pieces(tree))]
            yield pd.DataFrame(rows, columns=["tree_id", "at", "text", "template"]).astype({"template": "Int64"})

    return trees.select("tree_id", "tree").mapInPandas(work, _PIECES)


def inlined(pages: DataFrame, templates: DataFrame, depth: int = TEMPLATE_DEPTH) -> DataFrame:
    """``tree_id``, ``nth``, ``text``: the texts of ``pages`` with those of ``templates`` (``tree_id``, ``tree`` each) where they are named.

    Templates may name others, ``depth`` of them within each other; a page has each template once, at its first place in reading order, so templates that name
    themselves or one another come to an end. Templates are met by ``depth`` equi-joins; a place is a path of numbers, and paths in order are
    the page in order.
    """
    number = lambda c: F.lpad(F.col(c).cast("string"), 8, "0")
    parts = pieces(templates).select(F.col("tree_id").alias("of"), F.col("at").alias("inner"), F.col("text").alias("inner_text"), F.col("template").alias("inner_template"))
    level = pieces(pages).select("tree_id", number("at").alias("path"), F.array().cast("array<string>").alias("via"), "text", "template")
    rows, places = level, level.where("template IS NOT NULL")
    for n in range(depth):
        named = level.where("template IS NOT NULL")
        level = named.join(parts, F.col("template") == F.col("of")).select(
            "tree_id", F.concat("path", F.lit("/"), number("inner")).alias("path"), F.array_append("via", F.col("path")).alias("via"),
            F.col("inner_text").alias("text"), F.col("inner_template").alias("template"),
        )
        rows = rows.unionByName(level)
        if n + 1 < depth:
            places = places.unionByName(level.where("template IS NOT NULL"))
    # a page's places in reading order: one stays if its template was not seen and all that it lies in stays
    found = F.array_sort(F.collect_list(F.struct("path", "template", "via")))
    start = F.struct(F.array().cast("array<bigint>").alias("seen"), F.array().cast("array<string>").alias("kept"))

    def step(acc, place):
        stays = ~F.array_contains(acc["seen"], place["template"]) & F.forall(place["via"], lambda p: F.array_contains(acc["kept"], p))
        grown = F.struct(F.array_append(acc["seen"], place["template"]).alias("seen"), F.array_append(acc["kept"], place["path"]).alias("kept"))
        return F.when(stays, grown).otherwise(acc)

    kept = places.groupBy("tree_id").agg(F.aggregate(found, start, step)["kept"].alias("kept")).withColumnRenamed("tree_id", "page")
    texts = rows.where("text IS NOT NULL").join(kept, F.col("tree_id") == F.col("page"), "left")
    shown = texts.where(F.forall("via", lambda p: F.array_contains("kept", p)))
    of_page = F.array_sort(F.collect_list(F.struct("path", "text")))
    return shown.groupBy("tree_id").agg(of_page.alias("t")).select("tree_id", F.posexplode("t").alias("nth", "piece")).select("tree_id", "nth", F.col("piece.text").alias("text"))
