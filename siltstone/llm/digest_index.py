"""Exact deduplication with a persistent digest index.

The index is a table in the shared folder, bucketed and sorted by the SHA-256 digest
of the text. A batch is reduced to one row per digest (pre-aggregated before the
shuffle); a sort-merge anti-join with the index, whose side needs neither shuffle nor
sort, finds the new ones, which are appended. For known digests a row with the batch's
count alone is appended, so that group sizes hold over all batches. DataFrame functions
only: no Python runs on the executors.

Within a batch the row with the largest doc_id of equal texts stays; a text that the
index already holds keeps the document that the index names. A table that is added in
several batches goes in falling order of doc_id, so that the largest of all stays. Null
text counts as empty, very long texts are read whole. A null doc_id loses to any other.
Rows that repeat both the text and the largest doc_id are the same document:
:func:`exact_duplicates` marks all of them kept, :func:`keep_distinct` returns one. Extra
columns are ignored or carried through. No documents give no rows.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, fresh, safe_id, shared_dir, text_or_empty

#: Buckets of a new index at least, and rows for which one more is made.
BUCKETS = 64
BUCKET_ROWS = 4_000_000
BATCHES = 2


def digest(column: str = "text"):
    return F.unhex(F.sha2(text_or_empty(column), 256))


class DigestIndex:
    """(digest, keep_id, rows, named), bucketed and sorted by digest, at ``path``.

    One row of a digest is ``named`` and holds the document that stays; others count rows of later batches.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.path = path or shared_dir(spark)
        self.name = "digest_index_" + uuid.uuid4().hex
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, rows BIGINT, named BOOLEAN) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )
        atexit.register(self._forget)

    def _forget(self) -> None:
        """The name goes with the session; the files at a path of the user's stay."""
        try:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        except Exception:  # the session may have ended
            pass

    def _table(self) -> DataFrame:
        return self.spark.table(self.name)

    def read(self) -> DataFrame:
        """(digest, keep_id, group_size): buckets are aggregated where they lie."""
        return self._table().groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("rows").alias("group_size"))

    def add(self, documents: DataFrame) -> None:
        """Append the digests that the index lacks, each with its largest doc_id, and the number of rows of all."""
        batch = documents.select(digest().alias("digest"), F.col("doc_id").cast("long").alias("doc_id"))
        batch = batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("rows"))
        # one file per bucket: an uncoalesced shuffle by the bucket's own hash puts each bucket in one task
        batch = batch.repartition(self.buckets, "digest")
        known = self._table().where("named").select("digest").hint("merge")
        new = batch.join(known, "digest", "left_anti").withColumn("named", F.lit(True))
        rows = new
        if not self._table().isEmpty():
            again = batch.join(known, "digest", "left_semi")
            rows = new.unionByName(again.select("digest", F.lit(None).cast("long").alias("keep_id"), "rows", F.lit(False).alias("named"))).repartition(self.buckets, "digest")
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def describe(self, documents: DataFrame) -> DataFrame:
        """doc_id, keep_id, group_size, kept and text_sha256 of each row, by the index.

        Rows of a frequent text meet one row of the index: joining on the hexadecimal
        form leaves both sides to Spark's exchanges, so AQE can split such a text.
        """
        rows = documents.select("doc_id", F.sha2(text_or_empty(), 256).alias("text_sha256"))
        known = self.read().select(F.lower(F.hex("digest")).alias("text_sha256"), "keep_id", "group_size")
        return rows.join(known, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").cast("long").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def indexed(documents: DataFrame, path: str | None = None, batches: int = 1) -> DigestIndex:
    """An index of ``documents``, added in ``batches`` of falling ranges of doc_id; rows without one come last."""
    rows, low, high = documents.agg(F.count(F.lit(1)), F.min("doc_id").cast("long"), F.max("doc_id").cast("long")).first()
    index = DigestIndex(documents.sparkSession, path, max(BUCKETS, rows // BUCKET_ROWS))
    if batches < 2 or low is None:
        index.add(documents)
        return index
    edges = [low + (high - low + 1) * k // batches for k in range(batches)]
    doc_id = F.col("doc_id").cast("long")
    for k in range(batches - 1, -1, -1):
        part = doc_id >= edges[k]
        if k < batches - 1:
            part &= doc_id < edges[k + 1]
        index.add(documents.where(part if k else part | doc_id.isNull()))
    return index


def exact_duplicates(documents: DataFrame, path: str | None = None, batches: int = BATCHES) -> DataFrame:
    """One row per document, dropped ones too."""
    return indexed(documents, path, batches).describe(documents)


def keep_distinct(documents: DataFrame, path: str | None = None) -> DataFrame:
    """The documents that stay, one row each, with all their columns."""
    index = indexed(documents, path)
    sha, uid = fresh(documents, "text_sha256"), fresh(documents, "uid")
    known = index.read().select(F.lower(F.hex("digest")).alias(sha), F.coalesce("keep_id", F.lit(NULL_ID)).alias(uid))
    rows = documents.withColumns({sha: F.sha2(text_or_empty(), 256), uid: safe_id()})
    # the joined rows are dealt by both columns already, so that repeated ones meet without another shuffle
    return rows.join(known, [sha, uid], "left_semi").dropDuplicates([sha, uid]).select(*documents.columns)


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
