"""Small forms over whole tables: unit vectors, annotation lines, lenient matches, stamps, first rows, joins on a common key."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.vectors import l2_normalise
from corpusmill.operators import boxes, dedup, joins

from .evaluation import SHORT, shortened
from .items import SHEETS, sheet_boxes
from .registry import query, table


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) + 0.0 AS total, len(embedding) AS n FROM embeddings")
def unit_vectors(spark, sf_dir):
    unit = table(spark, sf_dir, "embeddings").withColumn("unit", l2_normalise(F.col("embedding")))
    total = F.aggregate("unit", F.lit(0.0), lambda s, x: s + x)
    return unit.select("vec_id", (F.round(total, 6) + 0.0).alias("total"), F.size("unit").cast("long").alias("n"))


@query(
    f"""WITH c AS (SELECT l_partkey, id, greatest(0, x1) AS x1, greatest(0, y1) AS y1, least(100, x2) AS x2, least(100, y2) AS y2 FROM ({SHEETS}))
SELECT l_partkey, id, printf('0 %.6f %.6f %.6f %.6f', (x1 + x2) / 2 / 100, (y1 + y2) / 2 / 100, (x2 - x1) / 100, (y2 - y1) / 100) AS line FROM c WHERE x2 > x1 AND y2 > y1"""
)
def polygon_annotation_lines(spark, sf_dir):
    """Line items as polygons on sheets of 100 by 100: clamped to the sheet, those without an area left out."""
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    points = F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2"))
    sheets = sheet_boxes(spark, sf_dir).select("l_partkey", "id", F.lit(100).alias("width"), F.lit(100).alias("height"), F.array(F.struct(points.alias("points"))).alias("subfigures"))
    found = boxes.polygons_to_boxes(sheets, ["l_partkey", "id"])
    return found.select("l_partkey", "id", boxes.box_line(F.col("cx"), F.col("cy"), F.col("bw"), F.col("bh")).alias("line"))


def ascii_sql(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


@query(
    f"""WITH s AS (SELECT conv_id % 3 AS kind, {ascii_sql('prediction')} AS p, {ascii_sql('reference')} AS r FROM ({SHORT})),
 m AS (SELECT kind, avg(CASE WHEN coalesce(p = r OR (length(r) >= 2 AND contains(p, r)), false) THEN 1.0 ELSE 0.0 END) AS share FROM s GROUP BY kind)
SELECT kind, printf('%.1f', round(100 * share, 1)) AS percent FROM m"""
)
def lenient_percent(spark, sf_dir):
    hit = T.lenient_match(F.col("prediction"), F.col("reference")).cast("double")
    return shortened(spark, sf_dir).groupBy((F.col("conv_id") % 3).alias("kind")).agg(T.percent(F.avg(hit)).alias("percent"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S') AS hour, count(*) AS n FROM events GROUP BY 1")
def stamped_hours(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(T.iso_stamp(F.date_trunc("hour", "ts")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT client_id, updated_at, source, name, email, city FROM clients
QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY updated_at DESC NULLS LAST, source NULLS LAST, name NULLS LAST, email NULLS LAST, city NULLS LAST) = 1"""
)
def latest_client_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "clients").select("client_id", "updated_at", "source", "name", "email", "city")
    order = [F.col("updated_at").desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in ("source", "name", "email", "city"))]
    return dedup.keep_first(rows, ["client_id"], order)


@query("SELECT i.kind, count(*) AS n, CAST(sum(l.quantity) AS DOUBLE) AS quantity FROM sale_lines l JOIN items i ON i.item_id = l.item_id GROUP BY i.kind")
def lines_by_common_key(spark, sf_dir):
    """Sale lines with their items: of the candidate keys the first that both tables have is ``item_id``."""
    both = joins.dynamic_key_join(table(spark, sf_dir, "sale_lines"), table(spark, sf_dir, "items"), ("brand", "item_id"))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").cast("double").alias("quantity"))
