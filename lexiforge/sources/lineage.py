"""Lineage over a catalog table: parent chains, mirrors, staleness and an append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parent pointers followed at most; a longer chain is an error, and one that returns to its child ends there.
DEPTH = 64


def chain(catalog: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(child, node, depth): each dataset and all it comes from, by a recursive query; a chain beyond depth raises."""
    query = """
    WITH RECURSIVE up(child, node, parent, depth) AS (
      SELECT name, name, parent, 0 FROM {catalog}
      UNION ALL
      SELECT up.child, c.name, c.parent, up.depth + 1
      FROM up JOIN {catalog} c ON up.parent = c.name
      WHERE up.depth <= :depth AND c.name <> up.child
    )
    SELECT child, node, CASE WHEN depth <= :depth THEN depth ELSE CAST(raise_error('a chain is too long: ' || child) AS INT) END AS depth FROM up
    """
    return catalog.sparkSession.sql(query, args={"depth": depth}, catalog=catalog)


def stale_mirrors(catalog: DataFrame) -> DataFrame:
    """Mirrors whose live digest differs from the recorded one of what they mirror."""
    source = catalog.select(F.col("name").alias("mirror_of"), F.col("recorded").alias("expected"))
    return catalog.where("mirror_of is not null").join(source, "mirror_of").select("name", "mirror_of", (F.col("live") != F.col("expected")).alias("stale"))


def content_digests(files: DataFrame) -> DataFrame:
    """md5 of files read with the binaryFile source."""
    return files.select("path", F.md5("content").alias("md5"))


def append_log(entries: DataFrame, path: str) -> None:
    """Adds (child, parent, digest, stamp) rows to an append-only JSON log."""
    entries.write.mode("append").json(path)
