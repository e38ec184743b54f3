"""Documents of typed blocks to chunks: sections between headings, cut at sentence ends, with the headings above them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Characters of a chunk (at least, at most), of the tail repeated in the next one, of a sentence that is cut; where sentences end.
LEAST, MOST, OVERLAP, HARD = 800, 1200, 120, 2000
SENTENCE_ENDS = r"(?<=[.!?…:;])\s+(?=[\p{Lu}\p{N}•])|\n+"
MAX_PATH = 512


def sections(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``section``, ``kind``, ``heading_path``, ``text`` from ``doc_id``, ``title``, ``blocks``.

    A heading of level 1 to 3 starts a section, named by title, last heading of level 1 or 2, and last one of level 3 below that. Lower
    headings are text. A section is of the kind of its first block where that is a table, a list, questions or facts, else prose. Sections without text are left out.
    """
    rows = documents.select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.posexplode("blocks").alias("pos", "block"))
    kind, text, level = F.col("block.kind"), F.coalesce("block.text", F.lit("")), F.coalesce("block.level", F.lit(0))
    rows = rows.select("doc_id", "title", "pos", kind.alias("kind"), text.alias("text"), F.when((kind == "heading") & level.between(1, 3), level).alias("starts"))
    upto = Window.partitionBy("doc_id").orderBy("pos")
    last = lambda wanted, what: F.last(F.when(wanted, what), ignorenulls=True).over(upto)
    top = F.col("starts") <= 2
    placed = rows.withColumns(
        {
            "section": F.count("starts").over(upto), "top_pos": last(top, F.col("pos")), "top": last(top, F.col("text")),
            "sub_pos": last(F.col("starts") == 3, F.col("pos")), "sub": last(F.col("starts") == 3, F.col("text")),
        }
    )
    below = F.when(F.col("sub_pos") > F.coalesce("top_pos", F.lit(-1)), F.col("sub"))
    names = F.filter(F.array("title", F.coalesce("top", F.lit("")), F.coalesce(below, F.lit(""))), lambda n: n != "")
    body = placed.withColumn("path", F.substring(F.array_join(names, " › "), 1, MAX_PATH)).where("starts IS NULL")
    said = F.when(F.col("kind") == "heading", F.concat("text", F.lit(":"))).otherwise(F.col("text"))
    found = body.groupBy("doc_id", "section").agg(
        F.min_by("kind", "pos").alias("first"), F.any_value("path").alias("heading_path"), F.array_sort(F.collect_list(F.struct("pos", said.alias("said")))).alias("parts")
    )
    whole = F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["said"]), "\n\n"), r"^\s+|\s+$", "")
    of_kind = F.when(F.col("first").isin("table", "list", "faq", "spec"), F.col("first")).otherwise("prose")
    return found.select("doc_id", "section", of_kind.alias("kind"), "heading_path", whole.alias("text")).where("text <> ''")


def piece_spans(text: str, lengths: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    """Where the pieces of ``text`` start and end, and whether blanks at their ends go; its sentences have these ``lengths`` and one blank between them.

    A piece ends with the last sentence that keeps it within ``MOST`` characters, or the first that makes it ``LEAST`` long, whichever comes later. The next piece starts in
    the last ``OVERLAP`` characters, after a blank. A sentence of over ``HARD`` characters ends its piece after that many, and goes on ``OVERLAP`` before.
    """
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    long = np.flatnonzero(lengths > HARD)
    start, sentence, done = 0, 0, 0  # ``done``: where the rest of a cut sentence starts
    while sentence < len(ends):
        within = int(np.searchsorted(ends, start + MOST, "right")) - 1
        enough = int(np.searchsorted(ends, start + LEAST, "left"))
        last = min(max(sentence, within, enough), len(ends) - 1)
        cut = next((i for i in long.tolist() if sentence <= i <= last + 1 and ends[i] - max(starts[i], done) > HARD), None)
        if cut is not None:
            first = int(max(starts[cut], done))
            end = first + HARD
            yield start, end, start < first
            start = done = end - OVERLAP
            sentence = cut
            continue
        yield start, int(ends[last]), last + 1 == len(ends)
        sentence = last + 1
        blank = text.find(" ", max(start, int(ends[last]) - OVERLAP), int(ends[last]) - 1)
        start = blank + 1 if blank >= 0 else int(ends[last]) + 1


def pieces(text: Column) -> Column:
    """The pieces of a section's text in order; a text of up to ``MOST`` characters is one."""

    def cut(flat: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([[t[a:b].strip() if bare else t[a:b] for a, b, bare in piece_spans(t, np.asarray(n, np.int64))] for t, n in zip(flat, lengths)], dtype=object)

    sentences = F.filter(F.transform(F.split(text, SENTENCE_ENDS), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    made = F.pandas_udf(cut, "array<string>")(F.array_join(sentences, " "), F.transform(sentences, lambda x: F.length(x)))
    return F.when(F.length(text) <= MOST, F.array(text)).otherwise(F.filter(made, lambda x: x != ""))


def chunk_documents(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``seq``, ``kind``, ``heading_path``, ``content``, ``token_est``, ``chunk_hash`` from ``doc_id``, ``title``, ``blocks``, ``structured``.

    Facts (``structured``, not empty) are the first chunk, of kind ``spec``. The first chunk starts with the title. A document is a page: its blocks meet in one
    task, two documents' never need to. Null title, blocks and facts are empty; ids must be unique.
    """
    title = F.coalesce("title", F.lit(""))
    facts = documents.where(F.coalesce("structured", F.lit("")) != "").select(
        "doc_id", F.lit(-1).cast("long").alias("section"), F.lit("spec").alias("kind"), F.substring(title, 1, MAX_PATH).alias("heading_path"), F.lit(0).alias("nth"), F.col("structured").alias("content")
    )
    cut = sections(documents).select("doc_id", "section", "kind", "heading_path", F.posexplode(pieces(F.col("text"))).alias("nth", "content"))
    order = Window.partitionBy("doc_id").orderBy("section", "nth")
    rows = facts.unionByName(cut).withColumn("seq", F.row_number().over(order) - 1)
    named = rows.join(documents.select("doc_id", title.alias("title")), "doc_id")
    headed = (F.col("seq") == 0) & (F.col("title") != "") & ~F.startswith("content", F.col("title"))
    content = F.when(headed, F.concat("title", F.lit("\n"), "content")).otherwise(F.col("content"))
    return named.select("doc_id", "seq", "kind", "heading_path", content.alias("content")).withColumns(
        {"token_est": F.ceil(F.length("content") / 4).cast("long"), "chunk_hash": F.sha1(F.concat_ws("|", "heading_path", "content").cast("binary"))}
    )
