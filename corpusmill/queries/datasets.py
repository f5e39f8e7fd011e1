"""Question and caption datasets, over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import datasets, split

from .curation import SPLIT
from .registry import STRIP, query, table

# Keyword tables that suit the test corpus.
LICENCES = {"MIT": ["mit license"], "Apache": ["apache license"], "GPL": ["gnu general public"], "other": ["licensed under", "all rights reserved"]}
TOPICS = {"with": [" with "], "was": [" was "], "avec": [" avec "], "nicht": [" nicht "], "como": [" para "]}


def keyword_sql(column: str, keywords: dict[str, list[str]]) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'contains(lower({column}), {chr(39)}{k}{chr(39)})' for k in keys)} THEN '{label}'" for label, keys in keywords.items())
    return f"CASE {cases} END"


@query(f"SELECT doc_id, {keyword_sql('text', LICENCES)} AS licence, {keyword_sql('text', TOPICS)} AS topic FROM documents")
def keyword_tags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.keyword_case(F.col("text"), LICENCES).alias("licence"), T.keyword_case(F.col("text"), TOPICS).alias("topic"))


VQA = f"""SELECT doc_id, split, u.question_type, u.answer FROM (SELECT d.doc_id, s.split, {keyword_sql('text', LICENCES)} AS m, {keyword_sql('text', TOPICS)} AS a, {STRIP.format('text')} AS c, count(*) OVER (PARTITION BY d.source) AS n
 FROM documents d JOIN ({SPLIT.format('documents')}) s USING (source)),
 LATERAL (SELECT * FROM (VALUES ('modality', m), ('anatomy', a), ('panel_caption', CASE WHEN c <> '' THEN c END), ('panel_count', CAST(n AS VARCHAR))) v(question_type, answer) WHERE v.answer IS NOT NULL) u"""


def vqa_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("panels_in_figure"))
    rows = datasets.vqa_rows(docs.join(counts, "source"), ["doc_id"], "text", "panels_in_figure", LICENCES, TOPICS)
    splits = split.grouped_split(docs.select("doc_id", "source"), "source").select("doc_id", "split")
    return datasets.with_split(rows, splits, "doc_id")


@query(VQA)
def vqa_rows(spark, sf_dir):
    return vqa_table(spark, sf_dir).select("doc_id", "split", "question_type", "answer")


@query(f"SELECT question_type, split, count(*) AS n FROM ({VQA}) GROUP BY 1, 2")
def question_type_counts(spark, sf_dir):
    return vqa_table(spark, sf_dir).groupBy("question_type", "split").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT 'crop/' || doc_id || '.png' AS image_path, {STRIP.format('text')} AS caption, doc_id FROM documents WHERE {STRIP.format('text')} <> ''")
def caption_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("crop", F.concat(F.lit("crop/"), F.col("doc_id").cast("string"), F.lit(".png")))
    return datasets.caption_pairs(docs, "crop", "text", ["doc_id"])


PANELS = f"""SELECT CAST(conv_id AS VARCHAR) AS figure_id, conv_id || '_' || chr(CAST(97 + turn AS INTEGER)) AS panel_id, role AS modality_tag, {keyword_sql('text', TOPICS)} AS anatomy_tag,
 CASE WHEN conv_id % 10 < 8 THEN 'train' WHEN conv_id % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM conversations"""
ELIGIBLE = f"""panels AS MATERIALIZED ({PANELS}), e AS (SELECT figure_id, list(panel_id ORDER BY panel_id) AS ids FROM panels GROUP BY 1
 HAVING count(*) >= 3 AND count(*) FILTER (modality_tag IS NOT NULL OR anatomy_tag IS NOT NULL) >= 2),
 p AS MATERIALIZED (SELECT panels.*, ids, upper(regexp_extract(panel_id, '_([A-Za-z]+)$', 1)) AS letter FROM panels JOIN e USING (figure_id))"""
PAIRS = """SELECT * FROM (SELECT a.figure_id, a.ids, a.split, a.letter AS l1, b.letter AS l2, a.modality_tag = b.modality_tag AS same,
 row_number() OVER (PARTITION BY a.figure_id, a.modality_tag = b.modality_tag ORDER BY a.letter, b.letter) AS r FROM p a JOIN p b ON a.figure_id = b.figure_id AND a.letter < b.letter WHERE a.modality_tag IS NOT NULL AND b.modality_tag IS NOT NULL) WHERE r = 1"""
ODD = """SELECT figure_id, any_value(ids) AS ids, any_value(split) AS split, arg_min(letter, n) AS answer FROM (SELECT figure_id, anatomy_tag, count(*) AS n, min(letter) AS letter, any_value(ids) AS ids, any_value(split) AS split FROM p WHERE anatomy_tag IS NOT NULL GROUP BY 1, 2)
 GROUP BY figure_id HAVING count(*) = 2 AND min(n) = 1 AND max(n) >= 2"""
QUESTIONS = f"""WITH {ELIGIBLE} SELECT figure_id, array_to_string(ids, ',') AS panel_ids, 'Do panels ' || l1 || ' and ' || l2 || ' show the same imaging modality?' AS question, 'modality_same_different' AS question_type, CASE WHEN same THEN 'same' ELSE 'different' END AS answer, split FROM ({PAIRS})
UNION ALL SELECT figure_id, array_to_string(ids, ','), 'Which panel shows a different anatomical structure than the others?', 'anatomy_odd_one_out', answer, split FROM ({ODD})
UNION ALL SELECT figure_id, array_to_string(any_value(ids), ','), 'How many panels show ' || modality_tag || '?', 'modality_count', CAST(count(*) AS VARCHAR), any_value(split) FROM p WHERE modality_tag IS NOT NULL GROUP BY figure_id, modality_tag"""


def panel_table(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    rest = F.col("conv_id") % 10
    return turns.select(
        F.col("conv_id").cast("string").alias("figure_id"),
        F.concat_ws("_", F.col("conv_id").cast("string"), F.chr(97 + F.col("turn"))).alias("panel_id"),
        F.col("role").alias("modality_tag"),
        T.keyword_case(F.col("text"), TOPICS).alias("anatomy_tag"),
        F.when(rest < 8, F.lit("train")).when(rest == 8, F.lit("val")).otherwise(F.lit("test")).alias("split"),
    )


def question_table(spark, sf_dir):
    return datasets.cross_panel_questions(panel_table(spark, sf_dir))


@query(QUESTIONS)
def cross_panel_questions(spark, sf_dir):
    return question_table(spark, sf_dir).withColumn("panel_ids", F.concat_ws(",", "panel_ids"))


@query(f"WITH {ELIGIBLE} SELECT figure_id, count(*) AS n_panels FROM p GROUP BY 1")
def eligible_figures(spark, sf_dir):
    return datasets.eligible_panels(panel_table(spark, sf_dir)).groupBy("figure_id").agg(F.count(F.lit(1)).alias("n_panels"))


@query(f"WITH {ELIGIBLE} SELECT figure_id, answer FROM ({ODD})")
def odd_one_out(spark, sf_dir):
    return question_table(spark, sf_dir).filter(F.col("question_type") == datasets.ODD_ONE_OUT).select("figure_id", "answer")


@query(f"WITH {ELIGIBLE} SELECT modality_tag AS modality, CAST(count(*) AS VARCHAR) AS answer, figure_id FROM p WHERE modality_tag IS NOT NULL GROUP BY figure_id, modality_tag")
def modality_counts(spark, sf_dir):
    counted = question_table(spark, sf_dir).filter(F.col("question_type") == datasets.COUNT)
    return counted.select(F.regexp_extract("question", "show (.*)[?]$", 1).alias("modality"), "answer", "figure_id")


@query(
    f"""WITH q AS MATERIALIZED ({QUESTIONS}), l AS (SELECT list_sort(list(DISTINCT upper(regexp_extract(x, '_([A-Za-z]+)$', 1)))) AS letters, max(n) AS most FROM (SELECT unnest(string_split(panel_ids, ',')) AS x, len(string_split(panel_ids, ',')) AS n FROM q))
SELECT DISTINCT question_type, array_to_string(CASE question_type WHEN 'modality_same_different' THEN ['same', 'different'] WHEN 'anatomy_odd_one_out' THEN list_append(letters, 'none') ELSE list_transform(range(0, most + 1), lambda i: CAST(i AS VARCHAR)) END, ',') AS answer_space FROM q, l"""
)
def answer_spaces(spark, sf_dir):
    spaces = datasets.with_answer_space(question_table(spark, sf_dir))
    return spaces.select("question_type", F.concat_ws(",", "answer_space").alias("answer_space")).distinct()


@query("SELECT role, string_agg(l, ',' ORDER BY num IS NULL, num, l) AS labels FROM (SELECT DISTINCT role, unnest([CAST(turn AS VARCHAR), CASE WHEN turn > 2 THEN 'late' ELSE 'early' END]) AS l, try_cast(l AS INTEGER) AS num FROM conversations) GROUP BY 1")
def label_space(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    labelled = turns.withColumn("labels", F.array(F.col("turn").cast("string"), F.when(F.col("turn") > 2, F.lit("late")).otherwise(F.lit("early"))))
    return datasets.label_space(labelled, "role", "labels").withColumn("labels", F.concat_ws(",", "labels"))
