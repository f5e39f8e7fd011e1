"""Merged sketches, tables of keywords and streams of changes, over the shop's tables and the documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusmill.operators import keywords, sketches
from corpusmill.plans.scratch import materialize, scratch_folder
from corpusmill.streaming import upsert

from .registry import query, table

QUANTILES = (0.25, 0.5, 0.75)


@query(
    "SELECT flag, u.col AS \"column\", count(u.v) AS n, min(u.v) AS low, max(u.v) AS high, true AS q25_ok, true AS q50_ok, true AS q75_ok, true AS distinct_ok"
    " FROM sale_lines, LATERAL (SELECT * FROM (VALUES ('quantity', CAST(quantity AS DOUBLE)), ('amount', amount)) t(col, v)) u WHERE u.v IS NULL OR NOT isnan(u.v) GROUP BY flag, u.col"
)
def merged_sketch_stats(spark, sf_dir):
    """Sketches of each month and flag, kept, merged by flag, and held against exact ranks and distinct counts."""
    lines = table(spark, sf_dir, "sale_lines").withColumn("month", F.trunc("shipped_at", "month"))
    columns = ["quantity", "amount"]
    kept = materialize(sketches.sketch_parts(lines, ["month", "flag"], columns, columns), "sketches")
    merged = materialize(sketches.merge_parts(kept, ["flag"]), "merged-sketches")
    shares = F.array(*(F.lit(q) for q in QUANTILES))
    told = [merged.select("flag", F.lit(c).alias("column"), F.col(f"{c}_n").alias("n"), F.col(f"{c}_low").alias("low"), F.col(f"{c}_high").alias("high"), F.array(*(sketches.quantile(c, q) for q in QUANTILES)).alias("q"), sketches.distinct_count(c).alias("different")) for c in columns]
    long = lines.select("flag", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("flag", "x.*").withColumnRenamed("flag", "f").withColumnRenamed("column", "c")
    # a row for each flag and column: the lines stay where they are and the few rows go to them
    told = told[0].union(told[1])
    marked = long.join(F.broadcast(told.select(F.col("flag").alias("tf"), F.col("column").alias("tc"), "q")), F.expr("f <=> tf and c = tc"))
    # each value once with how often it occurs, then one small row for each flag and column
    values = marked.groupBy("f", "c", "q", "v").agg(F.count("v").alias("times"))
    times = lambda held: F.sum(F.when(held, F.col("times")).otherwise(0))
    counts = values.groupBy("f", "c").agg(*(times(F.col("v") < F.col("q")[i]).alias(f"below{i}") for i in range(3)), *(times(F.col("v") <= F.col("q")[i]).alias(f"upto{i}") for i in range(3)), F.count("v").alias("exact"))
    counted = told.join(F.broadcast(counts), F.expr("flag <=> f and column = c"), "left")
    error = 2 * sketches.rank_error()
    ok = [F.coalesce((F.col(f"below{i}") <= (shares[i] + error) * F.col("n") + 1) & (F.col(f"upto{i}") >= (shares[i] - error) * F.col("n") - 1), F.lit(True)).alias(f"q{int(100 * q)}_ok") for i, q in enumerate(QUANTILES)]
    near = F.abs(F.col("different") - F.col("exact")) <= sketches.distinct_error() * F.col("exact") + 1
    return counted.select("flag", "column", "n", "low", "high", *ok, near.alias("distinct_ok"))


@query("SELECT client_id AS item, count(*) AS count FROM sales WHERE client_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 0.004 * (SELECT count(client_id) FROM sales)")
def frequent_clients(spark, sf_dir):
    """Clients of at least four in a thousand sales: candidates from daily sketches, counted exactly."""
    sales = table(spark, sf_dir, "sales").withColumn("day", F.to_date("sold_at"))
    return sketches.heavy_hitters(sales, "client_id", 0.004, ["day"])


WORDS = "SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS keyword FROM benchmark"


@query(f"SELECT keyword, count(*) AS texts FROM (SELECT keyword FROM ({WORDS}) WHERE length(keyword) >= 3) k JOIN documents d ON contains(lower(d.text), keyword) GROUP BY 1")
def keyword_table_hits(spark, sf_dir):
    """How many documents hold each word of the benchmark, also inside other words."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("keyword")).filter("length(keyword) >= 3")
    hits = keywords.keyword_hits(table(spark, sf_dir, "documents"), words, "doc_id", "text")
    return hits.groupBy("keyword").agg(F.count(F.lit(1)).alias("texts"))


@query(
    """SELECT client_id, seq, valid_at, change_id, source, segment, city, balance FROM client_changes
QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY seq DESC NULLS LAST, valid_at DESC NULLS LAST, change_id DESC NULLS LAST, op DESC NULLS LAST, source DESC NULLS LAST, segment DESC NULLS LAST, city DESC NULLS LAST, balance DESC NULLS LAST) = 1 AND coalesce(op, '') <> 'D'"""
)
def client_state(spark, sf_dir):
    """The clients as the changes leave them, taken by a stream in eight micro-batches of any order."""
    changes = materialize(table(spark, sf_dir, "client_changes").repartition(16, "change_id"), "changes")
    batch = -(-len(changes.inputFiles()) // 8)
    folder = scratch_folder(spark, f"client-state-{uuid.uuid4().hex}")
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", batch).parquet(changes.scratch_folder)
    keys, order = ["client_id"], ["seq", "valid_at", "change_id"]
    upsert.upsert_stream(stream, f"{folder}/table", f"{folder}/checkpoint", keys, order, merge_every=3)
    state = upsert.current(spark, f"{folder}/table", keys, order, "op = 'D'")
    return state.select("client_id", "seq", "valid_at", "change_id", "source", "segment", "city", "balance")
