"""Terms counted in Arrow batches are those of the columns, and no shuffle counts them."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from siltstone.functions import text as x
from siltstone.operators import retrieval as r
from siltstone.operators.postings_index import PostingsIndex

TEXTS = [
    "", None, "It's RUNNING - the runner's state-of-the-art v1.2.3. runs, run", "日本語テキスト und 東 straßen Straßen", "İstanbul ΟΔΟΣ ΟΔΟΣ. naïve ① Ⅷ x² _a_b_ ǅ",
    "a" * 48 + " " + "b" * 49 + " c", "l'azione dell'utente, ações aciones ungen Zeitungen", "𝒳𝒴 𐐀𐐁 e\u0301te\u0301 ½ cup", "tag-tag'tag.tag--end 'quoted' -x.",
]


def _chunks(spark):
    rows = [(i * 10 + k, i, lang, text, 1) for i, text in enumerate(TEXTS) for k, lang in enumerate([*x.SUFFIXES, "xx", None])]
    made = spark.createDataFrame(rows, "chunk_id long, doc_id long, lang string, text string, token_est long")
    odd = F.when(F.col("chunk_id") == 20, F.concat(F.lit(b"caf\xe9 \xff word "), F.col("text").cast("binary")).cast("string")).otherwise(F.col("text"))
    return made.withColumn("text", odd)


def test_terms_counted_in_batches_equal_those_of_the_columns(spark, tmp_path):
    chunks, langs = _chunks(spark), ("en", "de")
    open_ = lambda name, counts: PostingsIndex(spark, str(tmp_path / name), x.index_words, x.stem, ask_langs=langs, counts=counts)
    (kept, found), (old_kept, old_found) = open_("a", x.TermCounts)._analysed(chunks), open_("b", None)._analysed(chunks)
    got, want = (Counter(tuple(row) for row in df.select("term", "chunk_id", "doc_id", "lang", "tf").collect()) for df in (found, old_found))
    assert got == want and len(want) > 100 and max(want.values()) == 1
    terms = lambda df: {row.chunk_id: row.terms and {k: row.terms[k] for k in langs} for row in df.collect()}
    had = terms(old_kept)
    assert terms(kept) == {i: had[i] if TEXTS[i // 10] is not None else None for i in had}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    fresh = r.postings(chunks, x.index_words(F.col("text"), F.col("lang")), x.stem, keys=("chunk_id", "doc_id", "lang"))
    assert sorted(map(repr, fresh.collect())) == sorted(map(repr, old_found.collect()))
