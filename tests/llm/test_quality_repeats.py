"""Junk that repeats one word goes, though good prose has a repeat at times."""

import random

from prismarc.llm import quality


def test_repeated_words_are_told_by_their_number(spark):
    r = random.Random(5)
    vocabulary = [a + b + c for a in "abcdefgh" for b in "ou" for c in ("n", "rt", "sch", "l")]
    say = lambda k: r.choices(vocabulary, k=k)
    docs, labels = [], []
    for i in range(600):
        if i % 5 == 0:
            text = say(20) + [r.choice(vocabulary)] * r.randint(12, 200)
        else:  # a tenth of the good texts repeat a word three times
            text = say(60) + (["so"] * 3 if i % 10 == 1 else [])
        docs.append((i, " ".join(text)))
        if i % 2 or i % 20 == 0:
            labels.append((i, int(i % 5 > 0), 0))
    kept = {x.doc_id for x in quality.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    junk = set(range(0, 600, 5))
    assert not kept & junk
    assert kept == set(range(600)) - junk
