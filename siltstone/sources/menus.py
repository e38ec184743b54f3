"""Menus as text: each item with its address and the labels above it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels above an item, at most.
MAX_DEPTH = 10


def _label(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), "<[^>]*>", ""))


def ancestor_paths(items: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """``items`` (``menu_id``, ``item_id``, ``parent_id``, ``title`` and others) with ``path``: the labels above, from the top, ``depth`` at most.

    The way up ends where a parent is 0, null or not in the menu; in a cycle it goes round until ``depth``. Ways are doubled: after n equi-joins each
    item knows 2^n labels and who stands above them, so ten levels take four joins of a row an item, however deep or wide a menu is.
    """
    up = items.select("menu_id", "item_id", F.when(F.col("parent_id") > 0, F.col("parent_id")).alias("next"), _label(F.col("title")).alias("label"))
    known = up.select(F.col("menu_id").alias("m"), F.col("item_id").alias("above_id"), F.col("label").alias("above"))
    ways = up.join(known, (F.col("menu_id") == F.col("m")) & (F.col("next") == F.col("above_id")), "left").select(
        "menu_id", "item_id", F.when(F.col("above_id").isNotNull(), F.col("next")).alias("next"),
        F.when(F.col("above_id").isNotNull(), F.array("above")).otherwise(F.array().cast("array<string>")).alias("way"),
    )
    reached = 1
    while reached < depth:
        on = ways.select(F.col("menu_id").alias("m"), F.col("item_id").alias("above_id"), F.col("next").alias("above_next"), F.col("way").alias("above_way"))
        met = ways.join(on, (F.col("menu_id") == F.col("m")) & (F.col("next") == F.col("above_id")), "left")
        ways = met.select("menu_id", "item_id", F.col("above_next").alias("next"), F.concat("way", F.coalesce("above_way", F.array().cast("array<string>"))).alias("way"))
        reached *= 2
    path = F.reverse(F.slice("way", 1, depth)).alias("path")
    of = ways.select(F.col("menu_id").alias("m"), F.col("item_id").alias("i"), path)
    return items.join(of, (F.col("menu_id") == F.col("m")) & (F.col("item_id") == F.col("i"))).drop("m", "i")


def menu_lines(items: DataFrame) -> DataFrame:
    """``menu_id``, ``item_id``, ``line``, ``link`` of items with a label or an address: ``• label → url (top › above)``.

    An address of ``#`` is none; a null ``link`` is no link. Items must be unique by menu and id.
    """
    rows = ancestor_paths(items).withColumns({"label": _label(F.col("title")), "address": F.trim(F.coalesce("url", F.lit("")))})
    link = F.when(~F.col("address").isin("", "#"), F.col("address"))
    above = F.array_join(F.filter("path", lambda x: x != ""), " › ")
    line = F.concat(
        F.lit("• "), F.col("label"), F.coalesce(F.concat(F.lit(" → "), link), F.lit("")), F.when(F.size("path") > 0, F.concat(F.lit(" ("), above, F.lit(")"))).otherwise("")
    )
    return rows.where("label <> '' OR address <> ''").select("menu_id", "item_id", line.alias("line"), link.alias("link"))
