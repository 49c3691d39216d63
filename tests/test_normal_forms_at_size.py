"""Normal forms whose cost has to follow the text, against plain definitions."""

import hashlib

from pyspark.sql import functions as F

from prismarc.functions import normalise as N

LISTS = [["a", "b"], ["a"], [], None, ["x y", "", "b", "c"], [f"t{i % 7}é" for i in range(500)], ["a", "b", "c"], [""]]


def plain(tokens, digest, more):
    n = 3 if len(tokens) >= 3 else 1
    rows = [int.from_bytes(digest(" ".join(tokens[i : i + n]).encode())[:8], "big") for i in range(len(tokens) - n + 1)]
    bits = sum(1 << b for b in range(64) if more(2 * sum(r >> b & 1 for r in rows), len(rows)))
    return bits - (1 << 64) if bits >> 63 else bits


def test_fingerprints_by_definition_from_one_string_a_row(spark):
    df = spark.createDataFrame(list(enumerate(LISTS)), "i int, t array<string>").select("i", N.simhash(F.col("t")).alias("s"), N.majority_bits(F.col("t")).alias("m"))
    got = {r["i"]: (r["s"], r["m"]) for r in df.collect()}
    for i, tokens in enumerate(LISTS):
        blake, md5 = (lambda b: hashlib.blake2b(b, digest_size=8).digest()), (lambda b: hashlib.md5(b).digest())
        want = (plain(tokens, blake, lambda a, b: a >= b), plain(tokens, md5, lambda a, b: a > b)) if tokens else (0, None)
        assert got[i] == want, tokens
    assert df._jdf.queryExecution().optimizedPlan().toString().count("array_join") >= 2


def test_values_of_a_batch_are_few_objects_at_a_time(spark):
    """However many rows a batch has, only a few of its values have been made into objects and not been let go."""
    from prismarc.functions.records import by_value

    class Held(str):
        alive = most = 0

        def __new__(cls, v):
            Held.alive += 1
            Held.most = max(Held.most, Held.alive)
            return super().__new__(cls, v)

        def __del__(self):
            Held.alive -= 1

    def told(v):
        return Held(v) if int(v) % 1000 else str(Held.most)

    df = spark.range(0, 5001, 1, 1).select(by_value(told, "string")(F.col("id").cast("string")).alias("v"), "id")
    got = {r["id"]: r["v"] for r in df.collect()}
    assert len(got) == 5001 and got[4999] == "4999" and 1 < int(got[5000]) < 200


def test_digests_of_forms_leave_no_text_to_take_back(spark):
    rows = [("  Straße \t\u212b ",), (None,), ("",), ("ﬁ",)]
    df = spark.createDataFrame(rows, "c string")
    forms = {"prompt": N.normal_prompt, "term": N.normal_term, "gallery": N.normal_gallery}
    for r in df.select(*[N.form_digest(k, F.col("c")).alias(k) for k in N.FORMS], *[F.sha2(forms[k](F.col("c")), 256).alias(f"{k}2") for k in N.FORMS]).collect():
        assert all(r[k] == r[f"{k}2"] for k in N.FORMS)


def test_tokens_of_a_template_are_found_once(spark):
    df = spark.createDataFrame([("one two <x> <x> two two three four five six",), ("a b <x>",), (None,), ("one two three four five six seven eight",)], "c string").select(N.template_signature(F.col("c")).alias("s"))
    assert [r[0] for r in df.collect()] == ["one two <var> two three four five six", None, None, None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
