"""Fixity audit of WARC volumes by Merkle trees.

Pages become WARC records in volumes of consecutive ids; a record's leaf is its hash with its offset range, and nodes
hash FANOUT ordered ranges each, up to one root over all volumes. Two replicas are compared from the roots down, and
only children of differing nodes are looked at. Page bodies are hashed where they are read and are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import written

FANOUT, VOLUME = 16, 4096


def header(page_id: Column, url: Column, body: Column) -> Column:
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), page_id.cast("string"), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a record; null urls and bodies are empty."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(header(page_id, url, body), body, F.lit("\r\n\r\n"))


def records(pages: DataFrame) -> DataFrame:
    """page_id, volume, place, offset, length, sha256 of every page's record, volumes in the order of ids.

    Rows without an id can't be addressed and are left out. Rows that repeat an id follow each other by their hash.
    """
    made = pages.where("page_id is not null").select(F.col("page_id").cast("long"), record(F.col("page_id"), F.col("url"), F.col("html")).alias("r"))
    made = made.select("page_id", F.octet_length("r").cast("long").alias("length"), F.sha2(F.col("r").cast("binary"), 256).alias("sha256"))
    made = made.withColumn("volume", F.floor(F.col("page_id") / VOLUME))
    order = Window.partitionBy("volume").orderBy("page_id", "sha256")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return made.select(
        "page_id", "volume", (F.row_number().over(order) - 1).cast("long").alias("place"),
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"), "length", "sha256",
    )


def _heights(*replicas: DataFrame) -> tuple[int, int]:
    """Levels above the leaves within a volume, and above the volumes, that bring all replicas down to one node or, with negative ids, two."""
    tops = [r.agg(F.max("place"), F.min("volume"), F.max("volume")).first() for r in replicas]
    tops = [t for t in tops if t[0] is not None]
    place, low, high = max((t[0] for t in tops), default=0), min((t[1] for t in tops), default=0), max((t[2] for t in tops), default=0)
    inner = outer = 0
    while place:
        inner, place = inner + 1, place // FANOUT
    while low not in (high, -1) or high not in (low, 0):
        if low == high:
            break
        outer, low, high = outer + 1, low // FANOUT, high // FANOUT
    return inner, outer


def _parent(level: int, inner: int) -> list[Column]:
    """The node above a node of a level: of a range within its volume up to ``inner``, then of a range of volumes."""
    if level < inner:
        return [F.col("volume"), F.floor(F.col("node") / FANOUT)]
    return [F.floor(F.col("volume") / FANOUT), F.col("node")]


def tree(leaves: DataFrame, inner: int, outer: int) -> list[DataFrame]:
    """Levels of nodes (volume, node, hash), the leaves first and the root last."""
    levels = [written(leaves.select("volume", F.col("place").alias("node"), F.sha2(F.concat_ws("|", "offset", "length", "sha256"), 256).alias("hash")))]
    for level in range(inner + outer):
        child = F.col("node") if level < inner else F.col("volume")
        above = levels[-1].select(*(c.alias(n) for c, n in zip(_parent(level, inner), ("pv", "pn"), strict=True)), F.struct(child.alias("child"), "hash").alias("part"))
        joined = F.concat_ws("|", F.transform(F.array_sort(F.collect_list("part")), lambda x: F.concat_ws(":", x["child"], x["hash"])))  # FANOUT parts at most
        levels.append(written(above.groupBy(F.col("pv").alias("volume"), F.col("pn").alias("node")).agg(F.sha2(joined, 256).alias("hash"))))
    return levels


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """(volume, place) of the leaves in which two replicas differ, those that one of them lacks included.

    first, second: written tables of records(). Only children of differing nodes are compared.
    """
    inner, outer = _heights(first, second)
    a, b = tree(first, inner, outer), tree(second, inner, outer)
    on = ["volume", "node"]
    unlike = lambda x, y: x.join(y.withColumnRenamed("hash", "other"), on, "full_outer").where("not (hash <=> other)").select(*on)
    differ = unlike(a[-1], b[-1])
    for level in range(inner + outer - 1, -1, -1):
        marked = differ.select(F.col("volume").alias("pv"), F.col("node").alias("pn"))
        above = dict(zip(("pv", "pn"), _parent(level, inner), strict=True))
        differ = written(unlike(*(x[level].withColumns(above).join(marked, ["pv", "pn"], "left_semi").drop("pv", "pn") for x in (a, b))))
    return differ.select("volume", F.col("node").alias("place"))


def damaged(pages: DataFrame, every: int = 97) -> DataFrame:
    """A replica with a byte changed in each page whose id leaves 5 when divided by ``every`` and that has a body: damage to be found."""
    hit = (F.pmod("page_id", F.lit(every)) == 5) & (F.length("html") > 0)
    return pages.withColumn("html", F.when(hit, F.concat(F.when(F.col("html").startswith("#"), F.lit("%")).otherwise(F.lit("#")), F.substr("html", F.lit(2)))).otherwise(F.col("html")))


def check(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """records() of ``pages`` with corrupted: true where the replica's tree differs. Records that only the replica has aren't among them."""
    first, second = written(records(pages)), written(records(replica))
    found = audit(first, second).withColumn("corrupted", F.lit(True))
    return first.join(found, ["volume", "place"], "left").withColumn("corrupted", F.coalesce("corrupted", F.lit(False)))


#: The records and the planted damage in DuckDB's SQL.
SQL = f"""
WITH r AS (
  SELECT page_id, url, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))
    || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec, length(html) AS n
  FROM pages WHERE page_id IS NOT NULL
), m AS (
  SELECT CAST(page_id AS BIGINT) AS page_id, CAST(floor(page_id / {VOLUME}) AS BIGINT) AS volume, strlen(rec) AS length, sha256(rec) AS sha256, coalesce(n > 0 AND page_id % 97 = 5, false) AS corrupted FROM r
)
SELECT page_id, volume, CAST(row_number() OVER w - 1 AS BIGINT) AS place, CAST(coalesce(sum(length) OVER (PARTITION BY volume ORDER BY page_id, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  CAST(length AS BIGINT) AS length, sha256, corrupted
FROM m WINDOW w AS (PARTITION BY volume ORDER BY page_id, sha256)
"""
