"""Terms of many texts at once; an index that keeps no terms by asker reads its texts once."""

from __future__ import annotations

from siltstone.functions import text as x
from siltstone.operators.postings_index import PostingsIndex

TEXTS = ["", "runs, run (running) runs. it's a/b foo,bar foo--bar -x- 9", "日本語テキスト und 東", " \t\n", "naïve naïve. ½ cup x² _a_b_ " + "a" * 48 + " " + "b" * 49, "word " * 300]


def test_terms_of_many_texts_are_those_of_each(monkeypatch):
    for most in (200_000, 3):  # with words remembered, and forgotten at once
        monkeypatch.setattr(x.TermCounts, "REMEMBERED", most)
        for lang in (*x.SUFFIXES, "xx", None):
            counts = x.TermCounts(lang)
            for _ in range(2):
                places, terms, n = counts.of_texts(TEXTS)
                got = [{} for _ in TEXTS]
                for place, term, number in zip(places.tolist(), terms.to_pylist(), n.tolist()):
                    assert term not in got[place]
                    got[place][term] = number
                assert got == [x.TermCounts(lang)(text) for text in TEXTS]
    assert x.TermCounts("en").of_texts([""])[1].to_pylist() == []


def test_chunks_of_an_index_without_askers_need_no_analysis(spark, tmp_path):
    rows = [(i, i, "en" if i % 2 else "de", text, 1) for i, text in enumerate([*TEXTS, None])]
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id long, lang string, text string, token_est long")
    open_ = lambda name, langs: PostingsIndex(spark, str(tmp_path / name), x.index_words, x.stem, ask_langs=langs, counts=x.term_counts)
    bare, full = open_("bare", ()), open_("full", ("en",))
    kept, _ = bare._analysed(chunks)
    assert "MapInArrow" not in kept._jdf.queryExecution().executedPlan().toString()
    bare.apply(chunks)
    full.apply(chunks)
    of = lambda df: {r.chunk_id: r.terms and sorted(r.terms["en"]) for r in df.collect()}
    assert of(bare.with_terms(chunks.select("chunk_id", "text"), ("en",))) == of(full.chunks())
    assert sorted(map(str, bare.postings().collect())) == sorted(map(str, full.postings().collect()))
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    bare.apply(chunks)
    assert spark.conf.get(key, None) == before
