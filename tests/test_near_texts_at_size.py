"""Near texts on groups of near copies: what is moved follows the texts, not their pairs."""

import itertools
import random
import time

from pyspark.sql import functions as F

from prismarc.functions import normalise as N
from prismarc.functions import text as X
from prismarc.operators import overlaps
from prismarc.plans import catalogue


def moved(spark):
    time.sleep(1)  # figures come by a bus
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_pairs_of_near_copies_move_no_texts(spark, tmp_path):
    r = random.Random(3)
    words = [f"{r.getrandbits(60):x}" for _ in range(400)]
    docs = [(i, " ".join([*words[: i % 390], f"own{i // 2}", *words[i % 390 + 1 :]])) for i in range(200)] + [(None, "nothing here"), (900, None)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = moved(spark)
        got = {(x.left_id, x.right_id) for x in catalogue.queries()["near_texts"](spark, f"file://{tmp_path}").collect()}
        after = moved(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    prints = {i: N.majority(N.script_list(x)) for i, x in docs if i is not None and x}
    assert got == {(i, j) for i, j in itertools.combinations(range(200), 2) if (prints[i] ^ prints[j]).bit_count() <= 12} and len(got) > 5000
    assert after - before < 5 * sum(len(x or "") for _, x in docs)


def test_full_homes_are_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(overlaps, "BLOCK", 4)
    sets = spark.createDataFrame([(i, bytearray(b"\0".join(sorted([b"a", b"b%d" % (i % 3), *(b"t%d" % k for k in range(40))])))) for i in range(60)], "node long, own binary")
    nodes = overlaps.rare_keys(sets, "own", 0.12).select("node", "keys", "home")
    assert overlaps.with_block(nodes, "node").select("block").distinct().count() > 5
    got = {(x.node, x.other): x.met for x in overlaps.close_pairs(nodes, sets, "own", F.lit(True)).collect()}
    assert got == {(i, j): 42 if i % 3 == j % 3 else 41 for i, j in itertools.combinations(range(60), 2)}


def test_tokens_in_python_are_those_of_spark(spark):
    """Every code point, alone and within a word."""
    points = spark.range(1, 0x110000).filter("id NOT BETWEEN 55296 AND 57343").select("id")
    said = points.select(F.concat(F.lit("Ab"), F.udf(chr, "string")(F.col("id").cast("int")), F.lit("C9 ")).alias("c"), (F.col("id") / 512).cast("long").alias("g")).groupBy("g").agg(F.array_join(F.array_sort(F.collect_list("c")), "x ").alias("c")).repartition(8).localCheckpoint()
    assert said.select(N.majority_bits(X.tokens(F.col("c"))).eqNullSafe(N.latin_majority_bits(F.col("c"))).alias("same")).filter("NOT same").count() == 0
    whole = N.script_tokens(N.normal_text(F.col("c")))
    assert said.select(N.simhash(whole).alias("s"), N.script_simhash(F.col("c")).alias("o")).filter("s <> o").count() == 0
