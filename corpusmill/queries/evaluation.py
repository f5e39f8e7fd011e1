"""Scores, accounting and comparison tables, over conversations and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import datasets, dedup, evaluate
from corpusmill.streaming import incremental

from .datasets import QUESTIONS, TOPICS, keyword_sql, panel_table, question_table
from .registry import STRIP, query, table

# A user's turn stands for a prediction and the answer that follows for its reference.
ANSWERED = """SELECT conv_id, turn, text AS prediction, nxt AS reference FROM (SELECT *, lead(text) OVER w AS nxt, lead(role) OVER w AS nrole FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nrole = 'assistant'"""


def normal(column: str) -> str:
    return STRIP.format(rf"regexp_replace(lower({column}), '[^\p{{L}}\p{{N}}_\s\p{{Z}}]', '', 'g')")



def answered(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumns({"reference": F.lead("text").over(w), "next_role": F.lead("role").over(w)})
    return turns.filter("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prediction"), "reference")


F1 = r"""SELECT conv_id, turn, CASE WHEN len(p) = 0 OR len(r) = 0 THEN 0.0 ELSE 2.0 * list_sum(list_transform(list_distinct(list_intersect(p, r)), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(r, lambda x: x = w))))) / (len(p) + len(r)) END AS f1
 FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(prediction), '[\s\p{Z}]+'), lambda x: x <> '') AS p, list_filter(regexp_split_to_array(lower(reference), '[\s\p{Z}]+'), lambda x: x <> '') AS r FROM (""" + ANSWERED + "))"


@query(f"SELECT conv_id, turn, round(coalesce(f1, 0), 6) AS token_f1 FROM ({F1})")
def token_f1_scores(spark, sf_dir):
    return answered(spark, sf_dir).select("conv_id", "turn", F.round(T.token_f1(F.col("prediction"), F.col("reference")), 6).alias("token_f1"))


@query(f"SELECT conv_id, turn, CASE WHEN {STRIP.format('lower(prediction)')} = {STRIP.format('lower(reference)')} THEN 1.0::DOUBLE ELSE 0 END AS exact_match, CASE WHEN {STRIP.format('lower(prediction)')} = {STRIP.format('lower(upper(prediction))')} THEN 1.0::DOUBLE ELSE 0 END AS own FROM ({ANSWERED})")
def exact_match_scores(spark, sf_dir):
    p, r = F.col("prediction"), F.col("reference")
    return answered(spark, sf_dir).select("conv_id", "turn", T.exact_match(p, r).alias("exact_match"), T.exact_match(p, F.upper(p)).alias("own"))


# Predictions hold their reference, shortened to a word, or not.
SHORT = "SELECT conv_id, turn, prediction, CASE WHEN conv_id % 3 = 0 THEN string_split(prediction, ' ')[1] WHEN conv_id % 3 = 1 THEN 'none of it' ELSE prediction || '.' END AS reference FROM (" + ANSWERED + ")"


def shortened(spark, sf_dir):
    kind = F.col("conv_id") % 3
    short = F.when(kind == 0, F.element_at(F.split("prediction", " "), 1)).when(kind == 1, F.lit("none of it")).otherwise(F.concat("prediction", F.lit(".")))
    return answered(spark, sf_dir).withColumn("reference", short)


@query(f"SELECT conv_id, turn, CASE WHEN contains(p, r) THEN r ELSE p END AS cleaned FROM (SELECT conv_id, turn, {normal('prediction')} AS p, {normal('reference')} AS r FROM ({SHORT}))")
def clean_answer_scores(spark, sf_dir):
    return shortened(spark, sf_dir).select("conv_id", "turn", T.clean_answer(F.col("prediction"), F.col("reference")).alias("cleaned"))


@query(
    f"""WITH s AS (SELECT CASE conv_id % 4 WHEN 0 THEN 'modality' WHEN 1 THEN 'anatomy' WHEN 2 THEN 'panel_caption' ELSE 'panel_count' END AS question_type, turn % 4 = 2 AS failed,
  {normal('prediction')} AS p, {normal('reference')} AS r FROM ({SHORT})), c AS (SELECT question_type, failed, CASE WHEN contains(p, r) THEN 1.0 ELSE 0.0 END AS em FROM s WHERE question_type <> 'panel_count')
SELECT 'm' AS model, question_type, count(*) FILTER (NOT failed) AS n, count(*) FILTER (failed) AS n_errors, round(avg(em) FILTER (NOT failed), 6) AS exact_match FROM c GROUP BY GROUPING SETS ((question_type), ())"""
)
def metrics_by_type(spark, sf_dir):
    kind = F.element_at(F.array(*(F.lit(x) for x in ("modality", "anatomy", "panel_caption", "panel_count"))), (F.col("conv_id") % 4 + 1).cast("int"))
    failed = F.when(F.col("turn") % 4 == 2, F.lit("[ERROR: out of memory]")).otherwise(F.col("prediction"))
    df = shortened(spark, sf_dir).withColumns({"question_type": kind, "prediction": failed, "model": F.lit("m")})
    return evaluate.score_predictions(df, ["model"]).select("model", "question_type", "n", "n_errors", F.round("exact_match", 6).alias("exact_match"))


@query(
    """WITH r AS (SELECT conv_id, turn, role AS expected, lower(coalesce(CASE turn % 3 WHEN 0 THEN 'The user or system? Final answer: ' || role || '.' WHEN 1 THEN 'not the system, I think ' || role ELSE 'I cannot tell' END, 'None')) AS raw FROM conversations),
 l AS (SELECT *, trim(string_split(trim(string_split(raw, 'final answer:')[-1]), 'answer:')[-1]) AS low FROM r),
 c AS (SELECT *, list_filter(['user', 'assistant', 'system'], lambda x: x = trim(regexp_replace(low, '[^a-z0-9-]+', ' ', 'g'))) AS same,
  list_filter(list_transform(['user', 'assistant', 'system'], lambda x: {'at': length(regexp_extract(' ' || low || ' ', '^(.*[^a-z0-9])' || x || '[^a-z0-9].*$', 1)), 'c': x}), lambda h: h.at > 0) AS hits FROM l)
SELECT conv_id, turn, expected, CASE WHEN len(same) > 0 THEN same[-1] WHEN len(hits) > 0 THEN list_max(hits).c END AS parsed FROM c"""
)
def candidate_parse(spark, sf_dir):
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("The user or system? Final answer: "), "role", F.lit("."))).when(F.col("turn") % 3 == 1, F.concat(F.lit("not the system, I think "), "role")).otherwise(F.lit("I cannot tell"))
    options = F.array(F.lit("user"), F.lit("assistant"), F.lit("system"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("expected"), T.parse_candidate(raw, options).alias("parsed"))


@query(
    """WITH r AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN ' Yes. ' WHEN 1 THEN 'NO!' WHEN 2 THEN 'maybe' ELSE 'yes' END AS raw, CASE WHEN turn % 4 = 3 THEN 'kept' END AS given FROM conversations)
SELECT conv_id, turn, coalesce(given, CASE regexp_replace(lower(trim(raw)), '[^a-z]+', '', 'g') WHEN 'yes' THEN 'same' WHEN 'no' THEN 'different' END) AS answer FROM r"""
)
def yes_no_normalise(spark, sf_dir):
    kind = F.col("turn") % 4
    raw = F.when(kind == 0, F.lit(" Yes. ")).when(kind == 1, F.lit("NO!")).when(kind == 2, F.lit("maybe")).otherwise(F.lit("yes"))
    given = F.when(kind == 3, F.lit("kept"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.yes_no(given, raw, F.lit(datasets.SAME_DIFFERENT)).alias("answer"))


# Saved tags: every panel but one in seven has a modality, and its anatomy where there is one.
TAGS = f"""SELECT conv_id || '_' || chr(CAST(97 + turn AS INTEGER)) AS panel_id, role AS m, {keyword_sql('text', TOPICS)} AS a FROM conversations WHERE (conv_id + turn) % 7 <> 0"""
DERIVED = f"""WITH q AS MATERIALIZED ({QUESTIONS}), t AS MATERIALIZED ({TAGS}),
 x AS (SELECT q.*, u.panel_id AS pid, t.m, t.a, upper(regexp_extract(u.panel_id, '_([A-Za-z]+)$', 1)) AS letter FROM q, LATERAL (SELECT unnest(string_split(q.panel_ids, ',')) AS panel_id) u LEFT JOIN t ON t.panel_id = u.panel_id),
 s AS (SELECT figure_id, question, question_type, answer, split, max(m) FILTER (letter = upper(regexp_extract(question, 'panels (\\w+) and (\\w+)', 1))) AS m1, max(m) FILTER (letter = upper(regexp_extract(question, 'panels (\\w+) and (\\w+)', 2))) AS m2,
  bool_and(m IS NOT NULL) AS all_m, bool_and(a IS NOT NULL) AS all_a, count(*) FILTER (m = regexp_extract(question, 'show (.+?)\\?*$', 1)) AS k, count(DISTINCT a) AS tags FROM x GROUP BY ALL),
 o AS (SELECT figure_id, arg_min(letter, n) AS letter, min(n) AS least, max(n) AS most, count(*) AS tags FROM (SELECT figure_id, a, count(*) AS n, min(letter) AS letter FROM x WHERE question_type = 'anatomy_odd_one_out' AND a IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
 d AS (SELECT s.*, CASE WHEN question_type = 'modality_same_different' AND m1 IS NOT NULL AND m2 IS NOT NULL THEN CASE WHEN m1 = m2 THEN 'same' ELSE 'different' END
  WHEN question_type = 'modality_count' AND all_m THEN CAST(k AS VARCHAR) WHEN question_type = 'anatomy_odd_one_out' AND all_a THEN CASE WHEN o.tags = 1 THEN 'none' WHEN o.tags = 2 AND least = 1 AND most >= 2 THEN o.letter END END AS prediction
  FROM s LEFT JOIN o ON s.figure_id = o.figure_id AND s.question_type = 'anatomy_odd_one_out')"""


def derived(spark, sf_dir):
    panels = panel_table(spark, sf_dir)
    number = F.split("panel_id", "_")
    kept = panels.filter((F.col("figure_id").cast("long") + F.ascii(F.element_at(number, 2)) - 97) % 7 != 0)
    tags = kept.select("panel_id", F.explode(F.array(F.struct(F.lit("modality").alias("tag_type"), F.col("modality_tag").alias("tag")), F.struct(F.lit("anatomy").alias("tag_type"), F.col("anatomy_tag").alias("tag")))).alias("t"))
    tags = tags.select("panel_id", "t.tag_type", "t.tag", F.lit(0).alias("seq"))
    questions = question_table(spark, sf_dir).withColumn("question_id", F.concat_ws("||", "figure_id", "question"))
    return evaluate.derive_answers(questions, tags)


@query(f"{DERIVED} SELECT question_type, count(prediction) AS n_evaluated, count(*) - count(prediction) AS n_excluded, round(avg(CASE WHEN prediction = answer THEN 1.0 ELSE 0.0 END) FILTER (prediction IS NOT NULL), 6) AS accuracy FROM d GROUP BY 1")
def derived_answers_accounting(spark, sf_dir):
    return evaluate.accounting(derived(spark, sf_dir), ["question_type"]).withColumn("accuracy", F.round("accuracy", 6))


@query(f"{DERIVED} SELECT question_type, prediction, count(*) AS n FROM d WHERE prediction IS NOT NULL GROUP BY 1, 2")
def guess_distribution(spark, sf_dir):
    return evaluate.guess_distribution(derived(spark, sf_dir), ["question_type"])


@query(
    f"""{DERIVED} SELECT 'derived' AS method, split AS track, count(prediction) AS n_evaluated, count(*) - count(prediction) AS n_excluded, round(avg(CASE WHEN prediction = answer THEN 1.0 ELSE 0.0 END) FILTER (prediction IS NOT NULL), 6) AS overall,
 round(avg(CASE WHEN prediction = answer THEN 1.0 ELSE 0.0 END) FILTER (prediction IS NOT NULL AND question_type = 'modality_same_different'), 6) AS modality_same_different,
 round(avg(CASE WHEN prediction = answer THEN 1.0 ELSE 0.0 END) FILTER (prediction IS NOT NULL AND question_type = 'anatomy_odd_one_out'), 6) AS anatomy_odd_one_out,
 round(avg(CASE WHEN prediction = answer THEN 1.0 ELSE 0.0 END) FILTER (prediction IS NOT NULL AND question_type = 'modality_count'), 6) AS modality_count FROM d GROUP BY split"""
)
def ablation_table(spark, sf_dir):
    parts = derived(spark, sf_dir).select(F.lit("derived").alias("method"), F.col("split").alias("track"), "question_type", "answer", "prediction")
    out = evaluate.ablation_table(parts)
    return out.select("method", "track", "n_evaluated", "n_excluded", *(F.round(c, 6).alias(c) for c in out.columns[4:]))


@query("SELECT role AS model, count(*) AS n, round(avg(CASE WHEN turn % 3 <> 0 THEN 1.0 ELSE 0.0 END), 6) AS parsed, round(avg(CASE WHEN turn % 3 = 1 THEN 1.0 ELSE 0.0 END), 6) AS strict, round(avg(CASE WHEN turn % 3 <> 2 THEN 1.0 ELSE 0.0 END), 6) AS normalised FROM conversations GROUP BY 1")
def parsed_accuracy(spark, sf_dir):
    kind = F.col("turn") % 3
    df = table(spark, sf_dir, "conversations").select(
        F.col("role").alias("model"), F.lit(datasets.SAME_DIFFERENT).alias("question_type"), F.lit("same").alias("answer"), F.when(kind == 1, F.lit("same")).when(kind == 2, F.lit("different")).alias("prediction"), F.lit("Yes!").alias("raw_prediction")
    )
    out = evaluate.parsed_accuracy(df, ["model"])
    return out.select("model", "n", *(F.round(c, 6).alias(c) for c in ("parsed", "strict", "normalised")))


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS value, CASE WHEN l.quality IS NULL THEN 'base' ELSE 'new' END AS origin FROM documents d LEFT JOIN labels l USING (doc_id)")
def metric_upsert(spark, sf_dir):
    base = table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("value"), F.lit("base").alias("origin"))
    new = table(spark, sf_dir, "labels").filter("quality is not null").select("doc_id", F.col("quality").alias("value"), F.lit("new").alias("origin"))
    return dedup.upsert(base, new, ["doc_id"])


@query(
    """SELECT metric, max(value) FILTER (lang = 'en') AS en, max(value) FILTER (lang = 'fr') AS fr FROM (SELECT lang, unnest(['n', 'mean_quality', 'accept_rate']) AS metric,
 unnest([CAST(count(*) AS DOUBLE), round(avg(quality), 6), round(count(*) FILTER (quality = 1) / greatest(count(*), 1), 6)]) AS value FROM documents LEFT JOIN labels USING (doc_id) WHERE lang IN ('en', 'fr') GROUP BY lang) GROUP BY 1"""
)
def track_comparison(spark, sf_dir):
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").filter(F.col("lang").isin("en", "fr"))
    rows = df.groupBy(F.col("lang").alias("track")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.round(F.avg("quality"), 6).alias("mean_quality"), F.round(F.count_if(F.col("quality") == 1) / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("accept_rate")
    )
    tidy = rows.select("track", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("n", "mean_quality", "accept_rate")))).alias("x")).select("track", "x.*")
    return evaluate.compare_tracks(tidy, ["en", "fr"])


@query("SELECT 'n_docs' AS metric, CAST(count(*) AS DOUBLE) AS value FROM documents UNION ALL SELECT 'n_sources', count(DISTINCT source) FROM documents UNION ALL SELECT 'mean_chars', round(avg(n_chars), 6) FROM documents")
def summary_metrics(spark, sf_dir):
    return evaluate.summary_metrics(table(spark, sf_dir, "documents"), n_docs=F.count(F.lit(1)), n_sources=F.count_distinct("source"), mean_chars=F.round(F.avg("n_chars"), 6))


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 3")
def most_common_sources(spark, sf_dir):
    return evaluate.modes(table(spark, sf_dir, "documents"), "source", 3)


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_event_counts(spark, sf_dir):
    return incremental.windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))
