"""Scores of predictions, accounting of excluded rows, comparison tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators.datasets import COUNT, ODD_ONE_OUT, SAME_DIFFERENT

ERROR = "[ERROR"


def is_error(prediction: Column) -> Column:
    """Whether a prediction is a captured failure; null counts as one."""
    return F.coalesce(F.startswith(prediction, F.lit(ERROR)), F.lit(True))


def score_predictions(df: DataFrame, by: list[str], prediction: str = "prediction", reference: str = "reference", question_type: str = "question_type", drop_types: tuple[str, ...] = ("panel_count",), guard_empty: bool = False) -> DataFrame:
    """(by, question_type, n, n_errors, exact_match, token_f1): one row for each type and one, with a null type, for all.

    Predictions are cleaned against their references; errors and the types in ``drop_types`` do not count.
    """
    kept = df.filter(~F.coalesce(F.col(question_type).isin(*drop_types), F.lit(False)))
    cleaned = T.clean_answer(F.col(prediction), F.col(reference), guard_empty)
    target = T.normalise(F.col(reference))
    scored = kept.select(*by, question_type, is_error(F.col(prediction)).alias("failed"), T.exact_match(cleaned, target).alias("em"), T.token_f1(cleaned, target).alias("f1"))
    good = ~F.col("failed")
    out = scored.groupingSets([[*by, question_type], by], *by, question_type).agg(
        F.count_if(good).alias("n"),
        F.count_if(F.col("failed")).alias("n_errors"),
        F.avg(F.when(good, F.col("em"))).alias("exact_match"),
        F.avg(F.when(good, F.col("f1"))).alias("token_f1"),
    )
    return out


def derive_answers(questions: DataFrame, tags: DataFrame) -> DataFrame:
    """``questions`` with ``prediction``: answers that follow from saved single-panel tags; null where a tag is missing.

    ``tags`` has (panel_id, tag_type, tag, seq): the last tag of a panel and type counts.  Questions need question_id,
    panel_ids, question and question_type.
    """
    last = tags.filter("tag is not null").groupBy("panel_id", "tag_type").agg(F.max_by("tag", "seq").alias("tag"))
    need = F.when(F.col("question_type") == ODD_ONE_OUT, F.lit("anatomy")).otherwise(F.lit("modality"))
    asked = questions.select("question_id", "question", "question_type", need.alias("tag_type"), F.posexplode("panel_ids").alias("place", "panel_id"))
    asked = asked.join(last, ["panel_id", "tag_type"], "left").withColumn("letter", T.panel_letter(F.col("panel_id")))
    first = F.upper(F.regexp_extract("question", r"(?i)panels\s+(\w+)\s+and\s+(\w+)", 1))
    second = F.upper(F.regexp_extract("question", r"(?i)panels\s+(\w+)\s+and\s+(\w+)", 2))
    shown = F.regexp_extract("question", r"(?i)show\s+(.+?)\?*$", 1)
    asked = asked.withColumns({"first": first, "second": second, "shown": shown})
    sums = asked.groupBy("question_id", "question_type").agg(
        F.max(F.when(F.col("letter") == F.col("first"), F.col("tag"))).alias("a"),
        F.max(F.when(F.col("letter") == F.col("second"), F.col("tag"))).alias("b"),
        F.bool_and(F.col("tag").isNotNull()).alias("whole"),
        F.count_if(F.col("tag") == F.col("shown")).alias("counted"),
        F.max("shown").alias("shown"),
    )
    per_tag = asked.filter((F.col("question_type") == ODD_ONE_OUT) & F.col("tag").isNotNull()).groupBy("question_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.min_by("letter", "place").alias("letter"))
    odd = per_tag.groupBy("question_id").agg(F.count(F.lit(1)).alias("tags"), F.min("n").alias("least"), F.max("n").alias("most"), F.min_by("letter", "n").alias("letter"))
    kind = F.col("question_type")
    answer = (
        F.when((kind == SAME_DIFFERENT) & F.col("a").isNotNull() & F.col("b").isNotNull(), F.when(F.col("a") == F.col("b"), F.lit("same")).otherwise(F.lit("different")))
        .when((kind == COUNT) & F.col("whole") & (F.col("shown") != ""), F.col("counted").cast("string"))
        .when((kind == ODD_ONE_OUT) & F.col("whole"), F.when(F.col("tags") == 1, F.lit("none")).when((F.col("tags") == 2) & (F.col("least") == 1) & (F.col("most") >= 2), F.col("letter")))
    )
    derived = sums.join(odd, "question_id", "left").select("question_id", answer.alias("prediction"))
    return questions.join(derived, "question_id", "left")


def accounting(df: DataFrame, by: list[str], answer: str = "answer", prediction: str = "prediction") -> DataFrame:
    """(by, n_evaluated, n_excluded, accuracy): rows without a prediction are excluded and counted."""
    given = F.col(prediction).isNotNull()
    return df.groupBy(*by).agg(
        F.count_if(given).alias("n_evaluated"),
        F.count_if(~given).alias("n_excluded"),
        F.avg(F.when(given, (F.col(prediction) == F.col(answer)).cast("double"))).alias("accuracy"),
    )


def guess_distribution(df: DataFrame, by: list[str], prediction: str = "prediction") -> DataFrame:
    return df.filter(F.col(prediction).isNotNull()).groupBy(*by, prediction).agg(F.count(F.lit(1)).alias("n"))


def ablation_table(parts: DataFrame, types: tuple[str, ...] = (SAME_DIFFERENT, ODD_ONE_OUT, COUNT)) -> DataFrame:
    """(method, track, n_evaluated, n_excluded, overall, one accuracy for each type) from (method, track, question_type, answer, prediction)."""
    given = F.col("prediction").isNotNull()
    right = F.when(given, F.coalesce(F.col("prediction") == F.col("answer"), F.lit(False)).cast("double"))
    return parts.groupBy("method", "track").agg(
        F.count_if(given).alias("n_evaluated"),
        F.count_if(~given).alias("n_excluded"),
        F.avg(right).alias("overall"),
        *(F.avg(F.when(F.col("question_type") == t, right)).alias(t) for t in types),
    )


def parsed_accuracy(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, parsed, strict, normalised): shares of parsed answers, of right ones, and of right ones with yes and no read."""
    read = T.yes_no(F.col("prediction"), F.col("raw_prediction"), F.col("question_type"))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        share(F.col("prediction").isNotNull()).alias("parsed"),
        share(F.col("prediction") == F.col("answer")).alias("strict"),
        share(read == F.col("answer")).alias("normalised"),
    )


def compare_tracks(metrics: DataFrame, tracks: list[str]) -> DataFrame:
    """(metric, one column for each track) from tidy (metric, track, value); missing values are null."""
    return metrics.groupBy("metric").pivot("track", tracks).agg(F.first("value"))


def summary_metrics(df: DataFrame, **metrics: Column) -> DataFrame:
    """(metric, value): aggregates of one table as tidy rows, in one pass."""
    row = df.agg(*(c.cast("double").alias(n) for n, c in metrics.items()))
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in metrics))).alias("m")).select("m.*")


def modes(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent values with their counts; ties by value."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(column)).limit(k)
