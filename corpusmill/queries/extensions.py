"""Table functions, grouped Arrow aggregates and archives as a data source, over the documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusmill.functions import tables
from corpusmill.plans.scratch import materialize, scratch_folder
from corpusmill.sources import archive_source

from .registry import query, table

BUDGET = 20_000


@query(
    f"""WITH RECURSIVE s AS MATERIALIZED (SELECT source, doc_id // 1000 AS block, doc_id AS item, coalesce(length(text), 0) AS size, row_number() OVER (PARTITION BY source, doc_id // 1000 ORDER BY doc_id) AS rn FROM documents),
 w AS (SELECT source, block, item, rn, size, 0 AS pack, size AS total FROM s WHERE rn = 1
  UNION ALL SELECT s.source, s.block, s.item, s.rn, s.size, CASE WHEN w.total + s.size <= {BUDGET} THEN w.pack ELSE w.pack + 1 END, CASE WHEN w.total + s.size <= {BUDGET} THEN w.total + s.size ELSE s.size END
  FROM w JOIN s ON s.source IS NOT DISTINCT FROM w.source AND s.block = w.block AND s.rn = w.rn + 1)
SELECT source, block, CAST(pack AS BIGINT) AS pack, count(*) AS n_items, CAST(sum(size) AS BIGINT) AS total, min(item) AS first_item, max(item) AS last_item FROM w GROUP BY source, block, pack"""
)
def packed_documents(spark, sf_dir):
    """Consecutive documents of a source, by blocks of a thousand ids, in packs of at most BUDGET characters."""
    tables.register(spark)
    docs = table(spark, sf_dir, "documents").selectExpr("source", "doc_id div 1000 as block", "doc_id as item", "cast(length(text) as bigint) as size")
    return spark.sql(f"SELECT * FROM pack_rows(budget => {BUDGET}, rows => TABLE(SELECT * FROM {{docs}}) PARTITION BY (source, block) ORDER BY item)", docs=docs)


@query("SELECT source, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) + 0.0 AS language_bits FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) GROUP BY source")
def language_entropy(spark, sf_dir):
    """How mixed the languages of each source are."""
    tables.register(spark)
    docs = table(spark, sf_dir, "documents").select("source", "lang")
    return spark.sql("SELECT source, round(entropy_bits(n), 6) + 0.0D AS language_bits FROM (SELECT source, lang, count(*) AS n FROM {docs} GROUP BY source, lang) GROUP BY source", docs=docs)


@query("SELECT doc_id || '.txt' AS name, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS size, true AS safe, sha256(coalesce(text, '')) AS sha256 FROM documents")
def archived_documents(spark, sf_dir):
    """Every document as a member of a zip, read back by ranges of the archives."""
    archive_source.register(spark)
    folder = scratch_folder(spark, f"archives-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"))
    written = materialize(archive_source.write_archives(docs.repartition("name"), folder, "name", "content"), "archives")
    members = spark.read.format("archive").option("split_bytes", 16 * 2**20).load(folder)
    # only what finished tasks have listed counts
    listed = members.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(written.select(F.element_at(F.split("path", "/"), -1).alias("file")), "file", "left_semi")
    return listed.select("name", "size", "safe", F.sha2("content", 256).alias("sha256"))
