"""Texts are judged, not ids."""

from prismarc.llm import decontaminate


def test_a_repeated_id_keeps_its_clean_texts(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, item + " and more"), (1, "a clean text"), (2, None), (3, "clean"), (3, "clean"), (None, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.drop_contaminated(docs, bench).collect()), key=repr)
    assert got == sorted([(1, "a clean text"), (2, None), (3, "clean"), (3, "clean"), (None, item)], key=repr)
