"""Spelling variants against all pairs of words, and the SQL, with ties, nulls, repeats and frequent words."""

import random
import re
import zlib

import duckdb
import pytest

from prismarc.llm import registry, spelling

SF = "/root/testdata/sf0.001"


def brute(rows, every=97, least=5, often=3, ratio=2):
    counts = {}
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] = counts.get(run, 0) + 1
    n = {w: c for w, c in counts.items() if len(w) >= least and c >= often}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    around = {w: [o for o in n if near(w, o)] for w in n}
    form = {}
    for w, os_ in around.items():
        top = min(os_, key=lambda o: (-n[o], o), default=None)
        form[w] = top if top is not None and n[top] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(around[w]), n.get(form[w])))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def variants(seed):
    """Words with their replacements, insertions and deletions; ties; chains of forms; letters beyond ASCII; a very frequent word."""
    r = random.Random(seed)
    letters = "abcxyzéßÿ×"
    words = []
    for _ in range(12):
        w = "".join(r.choices(letters, k=r.randint(4, 9)))
        for _ in range(r.randint(2, 12)):
            k, c = r.randrange(len(w)), r.choice(letters)
            words += [r.choice([w, w[:k] + c + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + c + w[k:]])] * r.choice([1, 3, 3, 6, 7, 20])
    words += ["aaaaaaa"] * 5 + ["aaaaaaaa"] * 11 + ["aaaaaaaaa"] * 23 + ["aaaaab"] * 3 + ["Überall"] * 4 + ["überall"] * 9 + ["THE"] * 3000 + ["common"] * 3000 + ["commons"] * 9
    r.shuffle(words)
    seps = [" ", "1", "\n", "’", "日", "_"]
    rows = [(i, "".join(w + r.choice(seps) for w in words[i::40])) for i in range(40)]
    return rows + [(7, rows[7][1]), (None, rows[3][1]), (90, None), (91, ""), (92, " \n12"), (93, "q" * 3000 + " " + "q" * 2999 + (" " + "q" * 3000) * 3 + (" " + "q" * 2999) * 8)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed):
    rows = variants(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "'x' AS __word", "2 AS __i").repartition(6)
    want = brute(rows, every=5)
    assert sum(w[1] is not None for w in want) > 5 and max(w[4] for w in want) > 2
    assert found(spelling.spelling_variants(docs, every=5)) == want
    if seed == 1:
        assert found(spelling.spelling_variants(docs)) == brute(rows)


def test_chains_of_forms(spark):
    chain = [("abcdefgh"[:k] + "zz", 3 * 2**k) for k in range(3, 9)]  # each loses a letter of the next
    docs = spark.createDataFrame([(1, " ".join(" ".join([w] * n) for w, n in chain))], "doc_id long, text string")
    got = found(spelling.spelling_variants(docs, every=10**9))
    assert got == brute(docs.collect(), every=10**9)
    assert {g[2] for g in got} == {chain[-1][0]} and sum(g[1] is None for g in got) == 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert found(spelling.spelling_variants(docs)) == []
    assert found(spelling.spelling_variants(spark.createDataFrame([(1, None), (None, "a b c")], "doc_id long, text string"))) == []


def test_query_and_its_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = found(registry.queries()["op13_spelling"](spark, SF))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
        sql = db.sql(registry.oracle_sql()["op13_spelling"]).select("word, form, root, n, n_near, form_n").fetchall()
    assert sorted(got, key=repr) == sorted(sql, key=repr)
    small = [r for r in rows if r[0] is not None][:60]
    assert found(spelling.spelling_variants(spark.createDataFrame(small, "doc_id long, text string"))) == brute(small)
