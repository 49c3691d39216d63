"""Columns named as the operators' own, nulls anywhere and empty tables, for every operator and stage."""

import pytest
from pyspark.sql import functions as F
from test_operators import corpus

from prismarc.llm import chat, decontaminate, mixing, mpeg, quality, simhash, substring_words, suffixes, token_counts, warc

NAMES = (
    "__id __raw __k __spans __runs __h __c __p __gone __fp __weight __key __good __bucket __root __size __source __target __from __to size n_words kept copies rate target "
    "component_id item_id turns taken source_size quality toxic n_bytes frames payload media"
).split()


def clash(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in NAMES if c not in df.columns])


def documents(spark):
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in corpus(1, 20)]
    return clash(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


def labels(spark):
    rows = [(i, None if i == 3 else int(i % 3 > 0), None if i == 5 else int(i % 4 == 0)) for i in range(20)] + [(None, 1, 0), (7, 1, 0)]
    return clash(spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))


def items(spark):
    return clash(spark.createDataFrame([(1, corpus(1, 20)[3][1]), (2, None), (None, "a b c"), (3, "")], "item_id long, text string"))


def tokens(docs):
    import public_tokenizers

    return token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))


WHOLE = {"words": substring_words.dedup_words, "tokens": tokens, "mix": mixing.mix, "media": mpeg.media_digests, "prints": simhash.simhash_components, "bytes": suffixes.dedup_bytes}
FILTERS = {
    "keep": lambda d: quality.keep(d, labels(d.sparkSession)),
    "near": simhash.keep_one,
    "cut": suffixes.cut_repeats,
    "leaks": lambda d: decontaminate.drop_contaminated(d, items(d.sparkSession)),
}


@pytest.mark.parametrize("name", WHOLE)
def test_a_row_for_each_document(spark, name):
    docs = documents(spark)
    assert WHOLE[name](docs).count() == docs.count()
    assert WHOLE[name](docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", FILTERS)
def test_filters_pass_columns_on(spark, name):
    docs = documents(spark)
    out = FILTERS[name](docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert 0 < len(rows) <= docs.count() and all(r[c] == "clash" for r in rows for c in NAMES)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    assert FILTERS[name](docs.limit(0)).count() == 0


def test_tiling_clash(spark):
    docs = documents(spark)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items(spark)).collect()} == {(3, 1), (7000, 1)}
    assert decontaminate.contaminated(docs, items(spark).limit(0)).count() == 0


def test_chats_and_pages_clash(spark):
    turns = [(1, 0, "user", None), (1, 1, None, "x"), (None, 0, "user", "y"), (2, None, "assistant", ""), (2, 1, "assistant", "q"), (2, 1, "assistant", "q")]
    rows = clash(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert {r.conv_id: r.n_turns for r in chat.chat_digests(rows).collect()} == {1: 2, 2: 3, None: 1}
    assert chat.chat_digests(rows.limit(0)).count() == 0
    pages = clash(spark.createDataFrame([(1, None, None), (2, "http://a", "x"), (2, "http://a", "x"), (None, "u", "x"), (5, "", "")], "page_id long, url string, html string"))
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.warc_roundtrip(pages).collect()) == [(0, "response", None), (1, "response", None), (2, "response", None), (2, "response", None), (5, "revisit", 1)]
    assert warc.warc_roundtrip(pages.limit(0)).count() == 0
