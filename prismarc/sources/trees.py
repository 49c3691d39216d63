"""Git tree snapshots, content-addressed files, SQLite shards and reports."""

from __future__ import annotations

import fnmatch
import hashlib
import os
import sqlite3
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """commit_sha, path, mode, type, sha, size of the entries of snapshots, one JSON object a file."""
    schema = "commit_sha string, tree array<struct<path:string,mode:string,type:string,sha:string,size:long>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select("commit_sha", F.inline("tree"))


def classified(path: Column, rules: dict[str, str]) -> Column:
    """The class of the first glob that fits a path; 'other' if none does."""
    out = F.lit("other")
    for glob, name in reversed(list(rules.items())):
        out = F.when(path.rlike("^" + fnmatch.translate(glob).replace(r"\Z", "$").replace(r"\z", "$")), name).otherwise(out)
    return out


def blob_candidates(tree: DataFrame) -> DataFrame:
    """sha, path (the first of its paths), aliases: one candidate a blob, whatever its number of paths."""
    blobs = tree.filter("type = 'blob'").groupBy("sha").agg(F.min("path").alias("path"), F.count("*").alias("paths"))
    return blobs.select("sha", "path", (F.col("paths") - 1).alias("aliases"))


def pinned(files: DataFrame, content: str, sha: str) -> DataFrame:
    """``files`` whose content has the pinned git blob digest; another content raises."""
    head = F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8")
    own = F.sha1(F.concat(head, F.unhex(F.lit("00")), F.col(content)))
    return files.withColumn(content, F.when(own == F.col(sha), F.col(content)).otherwise(F.raise_error(F.concat(F.lit("not the pinned blob: "), F.coalesce(sha, F.lit("none")))).cast("binary")))


def write_content(rows: DataFrame, content: str, folder: str) -> DataFrame:
    """sha256, bytes, fresh of every content, each kept once in a file named by its digest; a file is never changed.

    ``folder`` is one that all machines see.  A file comes by a rename, so a task that is run again finds it whole or not at all.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for raw in batch[content]:
                digest = hashlib.sha256(raw).hexdigest()
                place = os.path.join(folder, digest[:2], digest)
                fresh = not os.path.exists(place)
                if fresh:
                    os.makedirs(os.path.dirname(place), exist_ok=True)
                    with open(f"{place}.{uuid.uuid4().hex}", "wb") as f:
                        f.write(raw)
                    os.replace(f.name, place)
                out.append((digest, len(raw), fresh))
            yield pd.DataFrame(out, columns=["sha256", "bytes", "fresh"])

    return rows.filter(F.col(content).isNotNull()).select(content).mapInPandas(run, "sha256 string, bytes long, fresh boolean")


def write_sqlite(rows: DataFrame, folder: str, key: str) -> DataFrame:
    """file, rows of SQLite shards, one a partition, each with an index on ``key``; written beside and renamed when whole."""
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        place = os.path.join(folder, f"shard-{TaskContext.get().partitionId():05d}.sqlite")
        os.makedirs(folder, exist_ok=True)
        draft, count = f"{place}.{uuid.uuid4().hex}", 0
        quoted = ", ".join(f'"{n}"' for n in names)
        with sqlite3.connect(draft) as db:
            db.execute(f"CREATE TABLE rows ({quoted})")
            for batch in batches:
                db.executemany(f"INSERT INTO rows VALUES ({', '.join('?' * len(names))})", batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None))
                count += len(batch)
            db.execute(f'CREATE INDEX by_key ON rows ("{key}")')
        db.close()
        os.replace(draft, place)
        yield pd.DataFrame({"file": [place], "rows": [count]})

    return rows.mapInPandas(run, "file string, rows long")


def escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def html_rows(rows: DataFrame) -> DataFrame:
    """value: an HTML table row for each row, every cell escaped; write it as text between a head and a foot."""
    cells = [F.concat(F.lit("<td>"), escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in rows.columns]
    return rows.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value"))
