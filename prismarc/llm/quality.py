"""Quality classification by importance resampling.

Two generative models of hashed n-grams: of the target, from labelled rows that
are good and not toxic, and of the raw text, from all documents.  The raw text
is the target plus a rest, so after scaling by the median ratio the ratio of the
models is at most one, and its logarithm is the log weight of an n-gram: how
sure one can be that it isn't the rest's.  A document's log importance weight is
the sum over its n-grams.  Documents are then resampled without replacement by
Gumbel top-k: those with the k largest values of weight / temperature + Gumbel
noise stay, with k the number of documents whose weight passes the threshold
that parts the labelled rows best.

A text's repeats of a word count by their number, in levels (1, 2, 4, 8 and more
and so on), each of which is an n-gram that a text has once.

N-grams without evidence have weight 0: a ratio counts only where ``docs``
labelled rejects or more (for a level of repeats two) hold the n-gram and their share is ``times`` that of
the labelled targets.  Near copies among the labelled rows count once there
(three MinHash values of five-word shingles).

The labelled rows are a sample of at most ``sample``, in the order of a hash of
the id; the raw model counts every n-gram of every document.  The noise is a
hash of the id, so reruns agree.  Null and empty texts have weight 0.  Labels
with a null grade aren't used; without labelled targets or rejects everything
stays.  Repeated rows have equal keys and stay or go together.  Further columns
are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, renamed, slices
from .repeats import U, mixed, prefix, spans_hash, word_hashes

BITS, ORDERS, SAMPLE, DOCS, TIMES, TEMPERATURE, SEED = 22, (1,), 20_000, 5, 10.0, 0.1, 7
BLOCKS, LEVELS = 64, 16
THRESHOLDS = (-1.0, -2.0, -3.0, -5.0, -8.0)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def buckets(raws: list[bytes], orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every n-gram of every text; each order has its own hash.

    A word said three times in a row counts as a repeat, whatever the word.  Bucket k < ``LEVELS`` is in a text once
    if that has 2**k repeats or more, so junk of repeats is told from prose that has one.
    """
    hashes, counts = word_hashes([r.translate(_LOWER) for r in raws])
    which = np.repeat(np.arange(len(raws)), counts)
    sums = prefix(mixed(hashes))
    found, texts = [], []
    for n in orders:
        at = np.arange(max(0, len(hashes) - n + 1))
        at = at[which[at] == which[at + n - 1]]
        found.append((spans_hash(sums, at, at + n) * U(2 * n + 1) >> U(64 - bits)).astype(np.int64))
        texts.append(which[at])
    at = np.arange(max(0, len(hashes) - 2))
    at = at[(hashes[at] == hashes[at + 1]) & (hashes[at] == hashes[at + 2]) & (which[at] == which[at + 2])]
    repeats = np.bincount(which[at], minlength=len(raws))
    for level in range(LEVELS):
        texts.append(np.flatnonzero(repeats >= 1 << level))
        found.append(np.full(len(texts[-1]), level, np.int64))
    return np.concatenate(found), np.concatenate(texts)


def raw_counts(docs: DataFrame, text_col: str, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """How often each bucket occurs in all documents.  The table has a fixed size, whatever the corpus."""
    width = (1 << bits) // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in slices(batches, "__text", 2 << 20):
            found, _ = buckets([x or b"" for x in as_bytes(batch, "__text")], orders, bits)
            some, often = np.unique(found, return_counts=True)
            total[some] += often
        for k in range(BLOCKS):
            part = total[k * width : (k + 1) * width]
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at.astype(np.int32).tobytes()]), pa.array([part[at].tobytes()])], names=["__block", "__at", "__n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, at, n in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                held.setdefault(k, np.zeros(width, np.int64))[np.frombuffer(at, np.int32)] += np.frombuffer(n, np.int64)
        for k, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()])], names=["__block", "__n"])

    parts = docs.select(F.col(text_col).alias("__text")).mapInArrow(count, "__block int, __at binary, __n binary")
    out = np.zeros(1 << bits, np.int64)
    for row in parts.repartition(BLOCKS // 4, "__block").mapInArrow(merge, "__block int, __n binary").toLocalIterator():
        out[row[0] * width : (row[0] + 1) * width] = np.frombuffer(row[1], np.int64)
    return out


def labelled_grams(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int, orders: tuple[int, ...], bits: int) -> DataFrame:
    """__id, __good, __bucket list and __count list of the sampled labelled rows, near copies once."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    graded = labels.select(F.col(id_col).alias("__id"), good.alias("__good")).filter("__id IS NOT NULL AND __good IS NOT NULL").groupBy("__id").agg(F.min("__good").alias("__good"))
    chosen = cut(graded.orderBy(F.xxhash64("__id"), "__id").limit(sample))  # at most ``sample`` narrow rows: fit to broadcast
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for raw in as_bytes(batch, "__text"):
                found, _ = buckets([raw or b""], orders, bits)
                some, often = np.unique(found, return_counts=True)
                hashes, _ = word_hashes([(raw or b"").translate(_LOWER)])
                at = np.arange(max(1, len(hashes) - 4)) if len(hashes) else np.zeros(0, np.int64)
                shingles = spans_hash(prefix(mixed(hashes)), at, np.minimum(at + 5, len(hashes)))
                least = [int(mixed(shingles + U(k)).min().view(np.int64)) if len(shingles) else 0 for k in (1, 2, 3)]
                for column, value in zip(rows, (some, often, *least), strict=True):
                    column.append(value)
            kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]], names=["__id", "__good", "__bucket", "__count", "__m1", "__m2", "__m3"])

    kind = dict(texts.dtypes)["__id"]
    grams = cut(texts.mapInArrow(run, f"__id {kind}, __good boolean, __bucket array<long>, __count array<long>, __m1 long, __m2 long, __m3 long"))
    firsts = grams.select("__id", "__m1", "__m2", "__m3")
    for m in ("__m1", "__m2", "__m3"):
        least = grams.groupBy("__good", m).agg(F.min("__id").alias("__least"))
        firsts = firsts.join(least.select("__least").distinct(), F.col("__id") == F.col("__least"), "left_semi")
    return grams.join(firsts.select("__id").distinct(), "__id", "left_semi").select("__id", "__good", "__bucket", "__count")


def log_ratios(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int, orders: tuple[int, ...], bits: int, least: int, times: float) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, log weights) of the n-grams with evidence; as many as the labelled sample bears out."""
    grams = cut(labelled_grams(docs, labels, id_col, text_col, sample, orders, bits))
    sides = {r[0]: r[1] for r in grams.groupBy("__good").count().collect()}
    n_good, n_bad = sides.get(True, 0), sides.get(False, 0)
    raw = raw_counts(docs, text_col, orders, bits)
    if not n_good or not n_bad:
        return np.zeros(0, np.int64), np.zeros(0)
    each = grams.select("__good", F.explode(F.arrays_zip("__bucket", "__count")).alias("__x")).select("__good", "__x.__bucket", "__x.__count")
    by = each.groupBy("__bucket").agg(
        F.coalesce(F.sum(F.when(F.col("__good"), F.col("__count"))), F.lit(0)).alias("__target"), F.count_if("__good").alias("__in_good"), F.count_if(~F.col("__good")).alias("__in_bad")
    )
    often = (F.col("__in_bad") + 0.5) / (n_bad + 1) / ((F.col("__in_good") + 0.5) / (n_good + 1))
    # there are few levels of repeats, so chance makes none evident that two rejects have
    enough = F.when(F.col("__bucket") < LEVELS, max(min(least, 2), n_bad / 500)).otherwise(max(least, n_bad / 500))
    by = by.withColumn("__evident", (F.col("__in_bad") >= enough) & (often >= times))
    words = by.agg(F.sum("__target")).first()[0] or 0
    # at most one bucket for every fifty words of the sample, and those with evidence: bounded as the sample is
    stats = by.filter((F.col("__target") >= 50) | F.col("__evident")).select("__bucket", "__target", "__evident").toArrow()
    b, target, evident = (stats.column(c).to_numpy() for c in ("__bucket", "__target", "__evident"))
    evident = evident.astype(bool)
    expected = raw[b] * (words / max(1, raw.sum()))
    sure = target >= 50
    if sure.any():  # raw = share * target + rest: the median n-gram is the target's
        ratio, weight = target[sure] / np.maximum(expected[sure], 1e-9), expected[sure]
        order = np.argsort(ratio)
        middle = min(np.searchsorted(np.cumsum(weight[order]), weight.sum() / 2), len(order) - 1)
        expected = expected * max(1.0, ratio[order][middle])
    evident &= expected > target
    order = np.argsort(b[evident])
    return b[evident][order], np.log((target[evident] + 1) / (target[evident] + expected[evident] + 2))[order]


def scored(text: Column, model: tuple[np.ndarray, np.ndarray], spark, orders: tuple[int, ...], bits: int) -> Column:
    """The log importance weight of each text."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, weights = sent.value
        table = np.zeros(1 << bits, np.float32)
        table[at] = weights
        for part in parts:
            raws = [bytes(x) if x is not None else b"" for x in part]
            out = np.zeros(len(raws))
            first = held = 0
            for i in range(len(raws) + 1):
                if i == len(raws) or held > 2 << 20:
                    found, which = buckets(raws[first:i], orders, bits)
                    out[first:i] = np.bincount(which, weights=table[found], minlength=i - first)
                    first, held = i, 0
                if i < len(raws):
                    held += len(raws[i])
            yield pd.Series(out)

    return score(text.cast("binary"))


def gumbel(id_col: Column, seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(seed)), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(values: DataFrame, k: int, bins: int = 4096) -> float:
    """A bound that the k largest values of column __key reach and no other does; equal values stay together.

    Bins are counted where the bound lies, finer and finer: a few numbers reach the driver.
    """
    low, high, n = values.agg(F.min("__key"), F.max("__key"), F.count("*")).first()
    if not n or k >= n:
        return float("-inf")
    left = k
    for _ in range(12):
        if low >= high:
            break
        step = (high - low) / bins
        at = F.least(F.floor((F.col("__key") - low) / step), F.lit(bins - 1)).cast("int").alias("__bin")
        within = values.filter(F.col("__key").between(low, high))
        counts = sorted(within.groupBy(at).agg(F.count("*"), F.min("__key"), F.max("__key")).collect(), reverse=True)
        for _, often, lo, hi in counts:
            if left <= often:
                low, high = lo, hi
                break
            left -= often
        if low == high or left == often:
            break
    return low


def drawn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE, orders: tuple[int, ...] = ORDERS, bits: int = BITS, least: int = DOCS, times: float = TIMES, temperature: float = TEMPERATURE, seed: int = SEED, k: int | None = None) -> DataFrame:
    """The rows of ``docs`` (columns by place) that stay, with __weight and __key.  Every text is scored once: the scored rows are written out."""
    model = log_ratios(docs, labels, id_col, text_col, sample, orders, bits, least, times)
    weighed = docs.withColumn("__weight", scored(F.col(text_col), model, docs.sparkSession, orders, bits))
    weighed = cut(weighed.withColumn("__key", F.col("__weight") / temperature + gumbel(F.col(id_col), seed)))
    if k is None:
        k = weighed.filter(F.col("__weight") >= best_threshold(weighed.select(F.col(id_col).alias("__id"), "__weight"), labels, id_col, sample)).count()
    return weighed.filter(F.col("__key") >= kth_largest(weighed.select("__key"), k))


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with __weight (log importance) and __key; the options are those of ``drawn``.  Columns of any name pass through."""
    plain, at = renamed(docs)
    graded = labels.select(F.col(id_col).alias(at[id_col]), "quality", "toxic")
    return drawn(plain, graded, at[id_col], at[text_col], **options).toDF(*docs.columns, "__weight", "__key")


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``resample`` keeps, with no further columns."""
    plain, at = renamed(docs)
    graded = labels.select(F.col(id_col).alias(at[id_col]), "quality", "toxic")
    return drawn(plain, graded, at[id_col], at[text_col], **options).select(*plain.columns).toDF(*docs.columns)


def best_threshold(keys: DataFrame, labels: DataFrame, id_col: str, sample: int) -> float:
    """Of ``THRESHOLDS`` the one that catches the most labelled rejects, a lost target counting as four."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    graded = labels.select(F.col(id_col).alias("__id"), good.alias("__good")).filter("__id IS NOT NULL AND __good IS NOT NULL").groupBy("__id").agg(F.min("__good").alias("__good"))
    chosen = graded.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    under = [F.count_if((F.col("__weight") < t) & (F.col("__good") == g)).alias(f"{'good' if g else 'bad'}{i}") for i, t in enumerate(THRESHOLDS) for g in (True, False)]
    row = keys.join(F.broadcast(chosen), "__id").agg(F.count_if("__good").alias("good"), F.count_if(~F.col("__good")).alias("bad"), *under).first()
    gain = lambda i: row[f"bad{i}"] / max(1, row["bad"]) - 4 * row[f"good{i}"] / max(1, row["good"])
    return THRESHOLDS[max(range(len(THRESHOLDS)), key=gain)]
