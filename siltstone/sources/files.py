"""Files as documents: text, Markdown, CSV, event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Header names of a title column, a question column (a title column too) and a content column, the first found counts.
TITLE = ["title", "question", "q", "domanda", "titolo", "name", "nome"]
QUESTION = ["question", "q", "domanda"]
CONTENT = ["content", "answer", "a", "risposta", "contenuto", "text", "testo", "description", "descrizione", "body"]
MAX_TITLE, MAX_ENTRY = 120, 4000


def split_text(content: Column, piece: int = 4000) -> Column:
    """Sections of a text: by ``#`` headings where there are two or more, else pieces of about ``piece`` characters at blank lines."""
    headed = F.filter(F.split(content, r"(?m)(?=^#{1,6} )"), lambda x: F.trim(x) != "")
    blank = F.filter(F.split(content, r"\n\s*\n"), lambda x: F.trim(x) != "")

    def add(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (F.length(last) + F.length(p) + 2 <= piece)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, F.lit("\n\n"), p)))
        return F.when(fits, grown).otherwise(F.concat(acc, F.array(p)))

    packed = F.aggregate(blank, F.array().cast("array<string>"), lambda a, p: F.when(F.size(a) == 0, F.array(p)).otherwise(add(a, p)))
    return F.when(F.regexp_count(content, F.lit(r"(?m)^#{1,6} ")) >= 2, headed).otherwise(packed)


def table_entries(rows: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """``title``, ``content``, ``type`` of a table's rows (and the columns of ``also``, as they are).

    With a title and a content column these make the entry, else its ``Header: value`` lines do, and the title is the first value that is no number.
    A table with a question column has entries of type ``faq``: ``Q: ...`` and ``A: ...``. Empty rows and entries without content are left out.
    """
    columns = [c for c in rows.columns if c not in also]
    lower = {c.strip().lower(): c for c in reversed(columns)}  # the first of equal names
    value = {c: F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in columns}
    first = lambda names: next((lower[n] for n in names if n in lower), None)
    title, content, faq = first(TITLE), first(CONTENT), first(QUESTION) is not None
    if title and content:
        said, body = value[title], value[content]
    else:
        texts = F.array(*value.values())
        said = F.coalesce(F.get(F.filter(texts, lambda v: (v != "") & v.try_cast("double").isNull()), F.lit(0)), F.lit(""))
        named = [F.when(value[c] != "", F.concat(F.lit(c.strip().lower()[:1].upper() + c.strip().lower()[1:] + ": "), value[c])) for c in columns if c.strip()]
        longest = F.aggregate(texts, F.lit(""), lambda a, v: F.when(F.length(v) > F.length(a), v).otherwise(a))
        body = F.concat_ws("\n", *named) if named else longest
    whole = F.concat(F.lit("Q: "), said, F.lit("\nA: "), body) if faq and title else F.substring(body, 1, MAX_ENTRY)
    shown = F.substring(F.when(said != "", said).otherwise(body), 1, MAX_TITLE)
    kept = rows.where(F.concat(*value.values()) != "").where(F.trim(body) != "")
    return kept.select(*also, shown.alias("title"), whole.alias("content"), F.lit("faq" if faq else "file").alias("type"))


def sse_events(lines: DataFrame, key: str = "stream_id", order: str = "line_no") -> DataFrame:
    """Events of a server-sent stream given as lines: comments dropped, ``data:`` lines of an event joined, blank lines end one."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    bare = F.regexp_replace("line", r"\r$", "")
    numbered = lines.withColumn("line", bare).withColumn("event", F.sum((F.col("line") == "").cast("int")).over(w) - (F.col("line") == "").cast("int"))
    data = numbered.where(F.startswith("line", F.lit("data:"))).withColumn("data", F.regexp_replace("line", r"^data: ?", ""))
    joined = data.groupBy(key, "event").agg(F.array_sort(F.collect_list(F.struct(order, "data"))).alias("d"))
    return joined.select(key, "event", F.array_join(F.transform("d", lambda x: x["data"]), "\n").alias("data"))
