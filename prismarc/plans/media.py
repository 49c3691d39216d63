"""Queries on image files, checked copies, polite fetches, bounded intakes, shards and private pages."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..sources import images, stores
from .register import query, t
from .releases import _RATED, _rated


def _place(spark, name: str) -> str:
    """A new folder in the shared one, as Spark and as Python name it."""
    return f"{graph.shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def _files(spark, d) -> DataFrame:
    """The vectors as grey PNG files of 8 by 8; every ninth of them is cut short."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grey = [np.floor((np.asarray(v, float) + 1) * 127.5).astype(np.uint8).reshape(8, 8) for v in batch["embedding"]]
            raws = [images.encode(g) for g in grey]
            yield pd.DataFrame({"vec_id": batch["vec_id"], "content": [r[:-12] if i % 9 == 4 else r for i, r in zip(batch["vec_id"], raws, strict=True)]})

    return t(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, content binary")


_GREY = "list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS BIGINT))"


@query(f"""WITH p AS (SELECT vec_id, vec_id % 9 <> 4 AS sound, {_GREY} AS p FROM embeddings)
SELECT vec_id, CASE WHEN sound THEN 'decoded' ELSE 'cut short' END AS state, CASE WHEN sound THEN CAST(8 AS BIGINT) END AS width, CASE WHEN sound THEN CAST(8 AS BIGINT) END AS height,
CASE WHEN sound THEN sha256(unhex('524742410000000800000008' || array_to_string(list_transform(p, lambda x: repeat(lpad(to_hex(x), 2, '0'), 3) || 'ff'), ''))) END AS pixel_sha256,
CASE WHEN sound THEN round(len(list_filter(p, lambda x: x // 32 = 3)) / 192.0, 8) END AS fourth, CASE WHEN sound THEN list_stddev_pop(p) < 4 OR len(list_distinct(p)) <= 4 END AS low FROM p""")
def raster_files(spark, d):
    """State, size, pixel digest, histogram and low-information flag of image files; broken ones have a state only."""
    own = images.signals(_files(spark, d))
    return own.select("vec_id", "state", "width", "height", "pixel_sha256", F.get("histogram", 3).alias("fourth"), F.col("low_information").alias("low"))


@query("SELECT DISTINCT 'docs/' || sha256(text) AS key, 'uploaded_verified' AS status, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def media_copies(spark, d):
    """Every distinct text put into a store under its digest and read back."""
    folder = _local(_place(spark, "store"))
    return graph.written(stores.copied(t(spark, d, "documents"), "text", lambda: stores.Folder(folder), "docs/"))


class Echo:
    """A client that answers every url with a body that names it; one with a fragment never answers."""

    def get(self, url: str) -> bytes:
        if "#" in url:
            raise OSError("no answer")
        return f"body of {url}".encode()


@query(r"""SELECT DISTINCT url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) AS host, CASE WHEN contains(url, '#') THEN 'failed' ELSE 'fetched' END AS state,
CASE WHEN NOT contains(url, '#') THEN CAST(strlen('body of ' || url) AS BIGINT) END AS bytes, CASE WHEN NOT contains(url, '#') THEN sha256('body of ' || url) END AS sha256 FROM pages WHERE url IS NOT NULL""")
def host_fetches(spark, d):
    """Receipts of one request for every url, one at a time for a host."""
    return stores.fetched(t(spark, d, "pages"), Echo)


def _links(body: str) -> tuple[list[str], bool]:
    """The link targets of a page; it is whole if it ends, and no page if it has no head."""
    if "<head" not in body:
        raise ValueError("no head")
    return [part.split('"', 1)[0] for part in body.split('href="')[1:]], "</html>" in body


def _containers(spark, d) -> DataFrame:
    host = F.regexp_extract("url", r"://([^/?#:]*)", 1)
    return t(spark, d, "pages").select(host.alias("source"), F.col("url").alias("path"), F.sha1("html").alias("sha"), F.col("html").alias("body"))


@query()
def sealed_intake(spark, d):
    """The links of the containers that a run takes; those of secure hosts were sealed two days before."""
    rows = _containers(spark, d)
    before = rows.filter("path LIKE 'https:%'").select("source", "path", "sha", F.to_timestamp(F.lit("2024-02-01 00:00:00")).alias("sealed_at"))
    taken = stores.intake(rows, before, _links, "2024-02-03 00:00:00")
    return taken.select("source", "path", "state", "sha256", F.size("items").cast("long").alias("items"))


@query("""WITH i AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 500 AS shard FROM documents)
SELECT doc_id, CAST(shard AS BIGINT) AS shard, lang, n_chars FROM i WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def shard_lookup(spark, d):
    """Documents found through the index of their shards."""
    path = _place(spark, "shards")
    stores.write_shards(t(spark, d, "documents"), path, "doc_id")
    keys = t(spark, d, "labels").filter("toxic = 1")
    return stores.from_shards(spark, path, keys, "doc_id").select("doc_id", F.col("shard").cast("long").alias("shard"), "lang", "n_chars")


@query(rf"""WITH {_RATED}, f AS (SELECT doc_id, tier, source FROM r WHERE doc_id > 40 AND tier <> 'P4' AND regexp_matches(lower(coalesce(text, '') || ' ' || coalesce(source, '')), '(^|[^a-z0-9])on([^a-z0-9]|$)') ORDER BY doc_id LIMIT 25),
k AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS i, count(*) OVER () AS c FROM f)
SELECT doc_id, tier, source, CASE WHEN i = 24 AND c = 25 THEN base64(encode(CAST(doc_id AS VARCHAR))) END AS next_cursor FROM k WHERE i <= 24""")
def private_page(spark, d):
    """A page of 24 private records after a cursor, without the quarantined, that hold a word; the last one has the next cursor if there is more."""
    words = F.lower(F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.coalesce("source", F.lit(""))))
    rows = _rated(spark, d).filter((F.col("doc_id") > 40) & (F.col("rights.tier") != "P4") & words.rlike("(^|[^a-z0-9])on([^a-z0-9]|$)"))
    page = graph.written(rows.select("doc_id", F.col("rights.tier").alias("tier"), "source").orderBy("doc_id").limit(25))
    ends = page.agg(F.count("*").alias("c"), F.sort_array(F.collect_list("doc_id")).alias("ids"))  # 25 ids at most
    more = F.when((F.col("c") == 25) & (F.col("doc_id") == F.get("ids", 23)), F.base64(F.encode(F.col("doc_id").cast("string"), "UTF-8")))
    return page.join(F.broadcast(ends)).filter((F.col("c") < 25) | (F.col("doc_id") <= F.get("ids", 23))).select("doc_id", "tier", "source", more.alias("next_cursor"))
