"""The inverted index against the texts: all, any, top, prefixes and parts; what a search reads."""

import collections
import random
import re

import pytest

from prismarc.operators import postings


def corpus(seed=1):
    r = random.Random(seed)
    words = ["the", "and", "of", "school", "schooling", "preschool", "a", "b2", "sch", "x9", "ünder"]
    rows = [(i * r.choice([1, 1, 7, 40_000]), " ".join(r.choices(words, weights=[9, 5, 5, 1, 1, 1, 3, 1, 1, 1, 1], k=r.randint(0, 25)))) for i in range(300)]
    return rows + [(None, "the and of"), (5000, None), (5001, ""), (-3, "The, AND-of!"), (-70_000, "the the the and of"), rows[8]]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path, rows = f"file://{tmp_path_factory.mktemp('index')}/i", corpus()
    postings.build(spark.createDataFrame(rows, "doc_id long, text string"), path)
    counts = collections.defaultdict(collections.Counter)
    for i, text in rows:
        if i is not None:
            counts[i].update(re.findall("[a-z0-9]+", (text or "").lower()))
    return path, counts


def ids(df):
    return sorted(r.id for r in df.collect())


def test_all_and_any(spark, index):
    path, counts = index
    for words in (["the", "and", "of"], ["school"], ["school", "b2"], ["the", "the"], ["absent"], ["the", "absent"], []):
        assert ids(postings.with_all(spark, path, words)) == sorted(i for i, c in counts.items() if words and all(c[w] for w in words))
        assert ids(postings.with_any(spark, path, words)) == sorted(i for i, c in counts.items() if any(c[w] for w in words))


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_top(spark, index, k):
    path, counts = index
    for words in (["the", "and", "of"], ["school"], ["absent"]):
        want = sorted(((-sum(c[w] for w in words), i) for i, c in counts.items()))[:k]
        assert [(-r.score, r.id) for r in postings.top(spark, path, words, k).collect()] == [x for x in want if x[0]]


def test_parts_and_prefixes(spark, index):
    path, counts = index
    for part in ("school", "choo", "sc", "s", "b2", "SCH", "nosuch", "der"):
        for prefix in (False, True):
            fit = (lambda w: w.startswith(part.lower())) if prefix else (lambda w: part.lower() in w)
            assert ids(postings.containing(spark, path, part, prefix)) == sorted(i for i, c in counts.items() if any(map(fit, c)))
    with pytest.raises(ValueError, match="a to z"):
        postings.tokens_with(spark, path, "a b")


def test_what_a_search_reads(spark, index):
    path, _ = index
    plan = postings.blocks_of(spark, path, ["school"])._jdf.queryExecution().executedPlan().toString()
    assert "folder" in plan.split("PartitionFilters: [")[1].split("]")[0] and "token,school" in plan.split("PushedFilters: [")[1].split("]")[0]
    blocks = postings.read(spark, path, postings.BLOCKS)
    assert blocks.filter("token = 'the'").count() > 20 and blocks.filter("token = 'school'").select("folder").distinct().count() == 1


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    postings.build(spark.createDataFrame([(1, None)], "doc_id long, text string"), path)
    assert ids(postings.with_all(spark, path, ["a"])) == ids(postings.containing(spark, path, "abc")) == postings.top(spark, path, ["a"], 3).collect() == []


def test_rows_that_move_are_pieces_and_the_index_is_counted_once(spark, tmp_path):
    """A row a token, stretch and piece goes through the shuffle, not one a token and document, and nothing is run twice for a range's sample."""
    sc = spark.sparkContext

    def stages():
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    docs = spark.range(4000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 50), i -> concat('w', pmod(i * 7 + id, 200)))) AS text")
    before, path = stages(), f"file://{tmp_path}/i"
    postings.build(docs, path)
    assert 0 < sum(n for k, n in stages().items() if k not in before) < 40_000  # of 200,000 tokens in documents
    blocks = postings.read(spark, path, postings.BLOCKS)
    assert blocks.agg({"n": "sum", "total": "sum"}).first()[:] == (200_000, 200_000)
    assert postings.read(spark, path, postings.VOCABULARY).agg({"times": "sum"}).first()[0] == 200_000
