"""Writers: tables, CSV, JSON summaries, annotation files, report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One Parquet folder for each split, pruned on reading."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; nested columns become JSON text.  ``mode='append'`` adds files to earlier ones."""
    nested = {c for c, t in df.dtypes if t.startswith(("array", "struct", "map"))}
    df.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns)).write.mode(mode).csv(path, header=True)


def write_summary(df: DataFrame, path: str) -> None:
    """A small table as JSON lines in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def annotation_lines(boxes: DataFrame, image: str) -> DataFrame:
    """(image, content): the text of each image's annotation file, a line for each box in order."""
    from corpusmill.operators.boxes import box_line

    line = box_line(F.col("cx"), F.col("cy"), F.col("bw"), F.col("bh"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("box_no"), line.alias("line"))))
    return boxes.groupBy(image).agg(F.concat_ws("\n", F.transform(ordered, lambda s: s["line"])).alias("content"))


def markdown_rows(df: DataFrame, columns: list[str]) -> Column:
    """A table row in Markdown."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |"))


def report_table(df: DataFrame, columns: list[str], order: list[Column], style: str = "markdown", limit: int = 1_000) -> str:
    """A small ordered table as Markdown or LaTeX text; raises ValueError above ``limit`` rows."""
    rows = df.select(*(F.col(c).cast("string").alias(c) for c in columns), F.struct(*order).alias("_o")).orderBy("_o").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("a report table must be small")
    cells = [["" if r[c] is None else r[c] for c in columns] for r in rows]
    if style == "markdown":
        return "\n".join("| " + " | ".join(x) + " |" for x in [columns, ["---"] * len(columns), *cells])
    if style == "latex":
        body = [" & ".join(x) + r" \\" for x in cells]
        return "\n".join([rf"\begin{{tabular}}{{{'l' * len(columns)}}}", r"\toprule", " & ".join(columns) + r" \\", r"\midrule", *body, r"\bottomrule", r"\end{tabular}"])
    raise ValueError(style)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One text file below ``path``, in any file system that Spark writes."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
