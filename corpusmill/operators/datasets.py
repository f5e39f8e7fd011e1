"""Question, caption and cross-panel datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators.align import is_panel_specific

# Question texts and types.
QUESTIONS = {
    "modality": "What imaging modality is shown in this panel?",
    "anatomy": "What anatomical structure is depicted?",
    "panel_caption": "What does the caption say about this panel?",
    "panel_count": "How many panels does this figure contain?",
}
ODD_QUESTION = "Which panel shows a different anatomical structure than the others?"
SAME_DIFFERENT, ODD_ONE_OUT, COUNT = "modality_same_different", "anatomy_odd_one_out", "modality_count"


def vqa_rows(df: DataFrame, keep: list[str], text: str = "best_match_text", count: str = "panels_in_figure", modality: dict | None = None, anatomy: dict | None = None, source: str = "keyword match") -> DataFrame:
    """The columns in ``keep`` and (question, answer, question_type, source): up to four rows for each item.

    Modality and anatomy by keyword, the text itself when it is not blank, the group's size when known.
    """
    caption = T.strip(F.col(text))

    def row(kind: str, answer: Column, origin: str) -> Column:
        fields = F.struct(F.lit(QUESTIONS[kind]).alias("question"), answer.alias("answer"), F.lit(kind).alias("question_type"), F.lit(origin).alias("source"))
        return F.when(answer.isNotNull(), fields)

    rows = F.array_compact(
        F.array(
            row("modality", T.keyword_case(F.col(text), modality or T.MODALITY_KEYWORDS), source),
            row("anatomy", T.keyword_case(F.col(text), anatomy or T.ANATOMY_KEYWORDS), source),
            row("panel_caption", F.when(caption != "", caption), "verbatim text"),
            row("panel_count", F.col(count).cast("long").cast("string"), "group size"),
        )
    )
    return df.select(*keep, F.explode(rows).alias("_q")).select(*keep, "_q.*")


def with_split(df: DataFrame, splits: DataFrame, key: str, default: str = "unassigned") -> DataFrame:
    """``df`` with the split of its key, or ``default``; ``splits`` has one row for each key."""
    named = splits.select(F.col(key).alias("_k"), F.col("split").alias("_s"))
    return df.join(named, F.col(key) == F.col("_k"), "left").withColumn("split", F.coalesce("_s", F.lit(default))).drop("_k", "_s")


def caption_pairs(df: DataFrame, image: str, text: str, keep: list[str]) -> DataFrame:
    """(image_path, caption, keep): items with a text that is not blank."""
    caption = T.strip(F.col(text))
    return df.filter(F.coalesce(caption != "", F.lit(False))).select(F.col(image).alias("image_path"), caption.alias("caption"), *keep)


def panel_tags(accepted: DataFrame, alignment: DataFrame, modality: dict | None = None, anatomy: dict | None = None) -> DataFrame:
    """``accepted`` with modality_tag and anatomy_tag from texts that are the panel's own.

    Joins one to one on ``panel_id`` and raises ValueError when a side repeats one.
    """
    from corpusmill.operators.joins import join_one_to_one, require_columns

    require_columns(accepted, ["figure_id", "panel_id", "split"])
    joined = join_one_to_one(accepted, alignment.select("panel_id", "assigned_segment_text", "alignment_mode"), ["panel_id"])
    own = F.when(is_panel_specific(F.col("alignment_mode")), F.col("assigned_segment_text"))
    return joined.withColumns({"modality_tag": T.keyword_case(own, modality or T.MODALITY_KEYWORDS), "anatomy_tag": T.keyword_case(own, anatomy or T.ANATOMY_KEYWORDS)})


def eligible_panels(panels: DataFrame, min_panels: int = 3, min_tagged: int = 2) -> DataFrame:
    """The panels of figures with enough panels and tags, with ``letter``, ``position`` (from 1, by letter), ``panel_ids``.

    Raises inside the plan when the panels of a figure are in several splits.
    """
    lettered = panels.withColumn("letter", T.panel_letter(F.col("panel_id")))
    ordered = F.array_sort(F.collect_list(F.struct("letter", "panel_id")))
    tagged = F.count_if(F.col("modality_tag").isNotNull() | F.col("anatomy_tag").isNotNull())
    figures = lettered.groupBy("figure_id").agg(
        F.count(F.lit(1)).alias("n_panels"), tagged.alias("n_tagged"), F.count_distinct("split").alias("n_splits"), ordered.alias("ordered")
    )
    figures = figures.filter((F.col("n_panels") >= min_panels) & (F.col("n_tagged") >= min_tagged))
    leak = F.raise_error(F.concat(F.lit("split leakage in figure "), F.col("figure_id").cast("string")))
    figures = figures.select(F.when(F.col("n_splits") > 1, leak.cast("string")).otherwise(F.col("figure_id").cast("string")).alias("_f"), F.transform("ordered", lambda o: o["panel_id"]).alias("panel_ids"), "n_panels")
    position = F.array_position(F.col("panel_ids"), F.col("panel_id"))
    return lettered.join(figures, F.col("figure_id").cast("string") == F.col("_f")).drop("_f").withColumn("position", position)


def cross_panel_questions(panels: DataFrame, min_panels: int = 3, min_tagged: int = 2) -> DataFrame:
    """(figure_id, panel_ids, question, question_type, answer, split) over eligible figures.

    For each figure the first pair of panels of one modality and the first of two, in reading order; the odd one out
    where exactly two anatomies occur, one of them once and the other more often; and the count of each modality.
    """
    panels = eligible_panels(panels, min_panels, min_tagged)
    figure = ["figure_id", "panel_ids", "split"]
    tagged = panels.filter("modality_tag is not null").select(*figure, "position", "letter", "modality_tag")
    # the first equal and the first different pair need the list of a figure's tags, a handful each
    listed = tagged.groupBy(*figure).agg(F.array_sort(F.collect_list(F.struct("position", "letter", "modality_tag"))).alias("tags"))
    pair = F.flatten(F.transform("tags", lambda a, i: F.transform(F.slice(F.col("tags"), i + 2, F.size("tags")), lambda b: F.struct(a["position"].alias("i"), b["position"].alias("j"), a["letter"].alias("a"), b["letter"].alias("b"), (a["modality_tag"] == b["modality_tag"]).alias("same")))))
    pairs = listed.select(*figure, pair.alias("pairs"))
    firsts = F.array(*(F.struct(F.lit(answer).alias("answer"), F.array_min(F.filter("pairs", (lambda p: p["same"]) if answer == "same" else (lambda p: ~p["same"]))).alias("pair")) for answer in ("same", "different")))
    pair_questions = (
        pairs.select(*figure, F.explode(firsts).alias("x"))
        .filter("x.pair is not null")
        .select(*figure, F.concat(F.lit("Do panels "), F.col("x.pair.a"), F.lit(" and "), F.col("x.pair.b"), F.lit(" show the same imaging modality?")).alias("question"), F.lit(SAME_DIFFERENT).alias("question_type"), F.col("x.answer").alias("answer"))
    )
    per_tag = panels.filter("anatomy_tag is not null").groupBy(*figure, "anatomy_tag").agg(F.count(F.lit(1)).alias("n"), F.min_by("letter", "position").alias("letter"))
    odd = per_tag.groupBy(*figure).agg(F.count(F.lit(1)).alias("tags"), F.min("n").alias("least"), F.max("n").alias("most"), F.min_by("letter", "n").alias("answer")).filter("tags = 2 and least = 1 and most >= 2")
    odd_questions = odd.select(*figure, F.lit(ODD_QUESTION).alias("question"), F.lit(ODD_ONE_OUT).alias("question_type"), "answer")
    counts = tagged.groupBy(*figure, "modality_tag").agg(F.count(F.lit(1)).cast("string").alias("answer"))
    count_questions = counts.select(*figure, F.concat(F.lit("How many panels show "), F.col("modality_tag"), F.lit("?")).alias("question"), F.lit(COUNT).alias("question_type"), "answer")
    out = pair_questions.unionByName(odd_questions).unionByName(count_questions)
    return out.select("figure_id", "panel_ids", "question", "question_type", "answer", "split")


def with_answer_space(questions: DataFrame) -> DataFrame:
    """``questions`` with ``answer_space``: one candidate list for each question type, over all questions.

    The letters of all panels in order and 'none'; '0' to the largest number of panels; 'same' and 'different'.
    """
    letters = questions.select(F.explode("panel_ids").alias("p")).select(T.panel_letter(F.col("p")).alias("l")).distinct().agg(F.array_sort(F.collect_list("l")).alias("letters"))
    most = questions.agg(F.max(F.size("panel_ids")).alias("most"))
    space = letters.crossJoin(most)  # one row each
    return questions.crossJoin(F.broadcast(space)).select(
        *questions.columns,
        F.when(F.col("question_type") == SAME_DIFFERENT, F.array(F.lit("same"), F.lit("different")))
        .when(F.col("question_type") == ODD_ONE_OUT, F.concat("letters", F.array(F.lit("none"))))
        .otherwise(F.transform(F.sequence(F.lit(0), F.col("most")), lambda i: i.cast("string")))
        .alias("answer_space"),
    )


def label_space(df: DataFrame, group: str, labels: str) -> DataFrame:
    """(group, labels): the union of a list column, numbers first by value, then text."""
    each = df.select(group, F.explode(labels).alias("l")).distinct()
    number = F.col("l").rlike("^[0-9]+$")
    key = F.struct((~number).alias("t"), F.when(number, F.col("l").cast("decimal(38,0)")).alias("n"), F.col("l").alias("l"))
    return each.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(key)), lambda k: k["l"]).alias(labels))


def padded(vectors: Column, size: int, width: int) -> Column:
    """struct(values, mask): a list of vectors filled with zero vectors up to ``size``, and which places are filled."""
    n = F.size(vectors)
    zero = F.array_repeat(F.lit(0.0), width)
    return F.struct(F.concat(vectors, F.array_repeat(zero, F.greatest(F.lit(0), size - n))).alias("values"), F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(size))), lambda i: i > n).alias("mask"))


def mean_pool(df: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """(group, n, pooled): the element-wise mean of each group's vectors; null vectors are masked out."""
    each = df.filter(F.col(vector).isNotNull()).select(group, F.posexplode(vector).alias("i", "x"))
    means = each.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    return means.groupBy(group).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("pooled"))


def first_in_group(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The first row of each group and its number of rows as ``group_rows``."""
    w = Window.partitionBy(group)
    return df.withColumns({"group_rows": F.count(F.lit(1)).over(w), "_r": F.row_number().over(w.orderBy(*order))}).filter("_r = 1").drop("_r")
