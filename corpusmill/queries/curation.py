"""Duplicates, canonical rows, splits, samples, cues and policy, over documents and embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusmill.functions.text import composite_key, key_from_stem
from corpusmill.functions.vectors import sign_bits
from corpusmill.operators import cues, dedup, joins, sampling, split
from corpusmill.plans.scratch import scratch_folder
from corpusmill.sources import cache, readers

from .registry import NON_ASCII, STRIP, query, table

BITS, NEAR = 63, 16

CANONICAL = f"""SELECT * EXCLUDE (rn) FROM (SELECT *, sha256(text) AS sha256, row_number() OVER (PARTITION BY sha256(text)
 ORDER BY coalesce({STRIP.format('text')} <> '', false) DESC, {NON_ASCII.format('text')}, coalesce(length(text), 0) DESC, doc_id) AS rn FROM documents) WHERE rn = 1"""
SPLIT = """SELECT source, CASE WHEN r <= floor(0.8 * n + 1e-9) THEN 'train'
 WHEN r <= floor(0.8 * n + 1e-9) + floor((n - floor(0.8 * n + 1e-9)) * 0.5 + 1e-9) THEN 'val' ELSE 'test' END AS split
 FROM (SELECT source, row_number() OVER (ORDER BY md5('42:' || source), source) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM {}))"""


def hashed(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("sha256", F.sha2("text", 256))


def canonical_rows(spark, sf_dir):
    return dedup.canonical(hashed(spark, sf_dir), "sha256", "text", "doc_id")


@query(
    f"""WITH k AS ({CANONICAL}), s AS ({SPLIT.format('k')})
SELECT s.split, count(*) AS n_rows, count(DISTINCT k.source) AS n_groups, count(l.quality) AS n_labelled, round(avg(l.quality), 6) AS mean_quality
FROM k JOIN s USING (source) LEFT JOIN labels l USING (doc_id) GROUP BY 1"""
)
def curation_summary(spark, sf_dir):
    kept = split.grouped_split(canonical_rows(spark, sf_dir), "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return kept.join(labels, "doc_id", "left").groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("source").alias("n_groups"), F.count("quality").alias("n_labelled"), F.round(F.avg("quality"), 6).alias("mean_quality")
    )


@query("SELECT sha256(text) AS sha256, count(*) AS size, array_to_string(list(doc_id ORDER BY doc_id)[1:5], ',') AS members FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, sf_dir):
    groups = dedup.exact_groups(hashed(spark, sf_dir), "sha256", "doc_id")
    return groups.withColumn("members", F.concat_ws(",", F.transform("members", lambda m: m.cast("string"))))


@query(
    """SELECT size, count(*) AS groups, count(*) FILTER (k = 1) AS same_key, count(*) FILTER (k > 1) AS cross_key
FROM (SELECT count(*) AS size, count(DISTINCT source) AS k FROM documents GROUP BY sha256(text) HAVING count(*) > 1) GROUP BY 1"""
)
def dup_group_size_hist(spark, sf_dir):
    return dedup.group_sizes(hashed(spark, sf_dir), "sha256", "source")


@query("SELECT CASE WHEN k = 1 THEN 'same_source' ELSE 'cross_source' END AS kind, count(*) AS groups, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT count(*) AS n, count(DISTINCT source) AS k FROM documents GROUP BY sha256(text) HAVING count(*) > 1) GROUP BY 1")
def dup_same_vs_cross_source(spark, sf_dir):
    groups = hashed(spark, sf_dir).groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("k")).filter("n > 1")
    return groups.groupBy(F.when(F.col("k") == 1, F.lit("same_source")).otherwise(F.lit("cross_source")).alias("kind")).agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n_rows"))


@query(f"SELECT doc_id, source, sha256 FROM ({CANONICAL})")
def canonical_documents(spark, sf_dir):
    return canonical_rows(spark, sf_dir).select("doc_id", "source", "sha256")


def bit_table(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", sign_bits(F.col("embedding"), BITS).alias("bits"))


BIT_SQL = f"""SELECT vec_id, CAST(list_sum(list_transform(range(1, {BITS + 1}), lambda i: CASE WHEN embedding[i] > 0 THEN CAST(1 AS HUGEINT) << (i - 1) ELSE 0 END)) AS BIGINT) AS bits FROM embeddings"""
PAIR_SQL = f"SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(a.bits, b.bits)) AS INTEGER) AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.bits, b.bits)) <= {NEAR}"
GROUP_SQL = f"""h AS MATERIALIZED ({BIT_SQL}), p AS MATERIALIZED ({PAIR_SQL}), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
 r AS (SELECT DISTINCT a AS id, a AS label FROM e UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.id), g AS (SELECT id, min(label) AS group_id FROM r GROUP BY id)"""


@query(f"WITH h AS MATERIALIZED ({BIT_SQL}) {PAIR_SQL}")
def near_dup_pairs(spark, sf_dir):
    return dedup.near_pairs(bit_table(spark, sf_dir), "vec_id", "bits", NEAR, BITS)


@query(f"WITH RECURSIVE {GROUP_SQL} SELECT id, group_id FROM g")
def near_dup_components(spark, sf_dir):
    return dedup.near_groups(near_dup_pairs(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {GROUP_SQL}, d AS (SELECT doc_id AS id, sha256(text) AS sha FROM documents JOIN embeddings ON doc_id = vec_id),
x AS (SELECT d.id, g.group_id, min(d.id) OVER (PARTITION BY sha) AS first_exact FROM d LEFT JOIN g USING (id))
SELECT id, CASE WHEN id <> first_exact THEN 'exact_duplicate' WHEN group_id <> id THEN 'near_duplicate' END AS duplicate_flag FROM x"""
)
def duplicate_flags(spark, sf_dir):
    docs = hashed(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    return dedup.duplicate_flags(docs, "doc_id", "sha256", near_dup_components(spark, sf_dir))


@query(f"WITH s AS ({SPLIT.format('documents')}) SELECT doc_id, source, split FROM documents JOIN s USING (source)")
def grouped_split(spark, sf_dir):
    return split.grouped_split(table(spark, sf_dir, "documents"), "source").select("doc_id", "source", "split")


@query(f"WITH s AS ({SPLIT.format('documents')}) SELECT split, lang, count(*) AS n_rows, count(DISTINCT source) AS n_groups FROM documents JOIN s USING (source) GROUP BY 1, 2")
def split_summary(spark, sf_dir):
    return split.grouped_split(table(spark, sf_dir, "documents"), "source").groupBy("split", "lang").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("source").alias("n_groups"))


@query(
    f"""WITH s AS ({SPLIT.format('documents')}), g AS (SELECT sha256(text) AS h, count(DISTINCT split) AS n FROM documents JOIN s USING (source) GROUP BY 1)
SELECT count(*) AS groups, count(*) FILTER (n > 1) AS leaking_groups, CAST(coalesce(sum(n * (n - 1) // 2), 0) AS BIGINT) AS overlaps FROM g"""
)
def split_leakage(spark, sf_dir):
    return split.leakage(split.grouped_split(hashed(spark, sf_dir), "source"), "sha256")


@query(
    f"""WITH s AS ({SPLIT.format('documents')}), d AS (SELECT doc_id, sha256(text) AS h, split FROM documents JOIN s USING (source)),
v AS (SELECT h, split, count(*) AS n FROM d GROUP BY 1, 2), b AS (SELECT h, split, row_number() OVER (PARTITION BY h ORDER BY n DESC, split) AS r FROM v)
SELECT d.doc_id, b.split FROM d JOIN b ON d.h = b.h AND b.r = 1"""
)
def split_reuse_majority_repair(spark, sf_dir):
    given = split.grouped_split(hashed(spark, sf_dir), "source")
    return split.reuse_or_split(given, "sha256").select("doc_id", "split")


LETTERS, LETTER_LIST, WORD = r"[.]\n", r"(?i)(^|[^a-z])[a-h](, | and | & )[a-h]([^a-z]|$)", r"(?i)(^|[^a-z])(licensed|reserved|contact|version|released)([^a-z]|$)"
CUES = f"""SELECT *, list_filter([CASE WHEN len(regexp_extract_all(text, '{LETTERS}')) >= 2 THEN 'panel_letters_x' || len(regexp_extract_all(text, '{LETTERS}')) END,
 CASE WHEN regexp_matches(text, '{LETTER_LIST}') THEN 'panel_letter_list' END, CASE WHEN regexp_matches(text, '{WORD}') THEN 'panel_word' END], lambda x: x IS NOT NULL) AS found,
 CASE WHEN n_chars / 1500.0 >= 1.8 THEN 'wide' WHEN n_chars / 1500.0 <= 0.5 THEN 'tall' END AS aspect FROM documents"""
BUCKET = """CASE WHEN a AND (l OR w) THEN 'both_signals' WHEN l AND w THEN 'caption_letter_and_word' WHEN l THEN 'caption_letter_only' WHEN w THEN 'caption_word_only' WHEN a THEN 'aspect_only' ELSE 'unflagged' END"""
BUCKETS = f"""SELECT doc_id, {BUCKET} AS signal_bucket FROM (SELECT doc_id, aspect IS NOT NULL AS a, list_contains(found, 'panel_word') AS w,
 len(list_filter(found, lambda x: x <> 'panel_word')) > 0 AS l FROM ({CUES}))"""


def cue_table(spark, sf_dir):
    caption = cues.caption_cues(F.col("text"), LETTERS, LETTER_LIST, WORD)
    aspect = cues.aspect_cue(F.col("n_chars"), F.lit(1500))
    return table(spark, sf_dir, "documents").withColumn("cues", caption).withColumn("compound_reasons", cues.reasons(F.col("cues"), aspect))


@query(f"SELECT doc_id, array_to_string(found, ';') AS caption_cues, coalesce(aspect, '-') AS aspect FROM ({CUES})")
def caption_cues(spark, sf_dir):
    aspect = F.regexp_extract(F.element_at("compound_reasons", -1), "^(wide|tall)_", 1)
    df = cue_table(spark, sf_dir).withColumn("aspect", F.when(F.size("compound_reasons") > F.size("cues"), aspect).otherwise(F.lit("-")))
    return df.select("doc_id", F.concat_ws(";", "cues").alias("caption_cues"), "aspect")


@query(f"SELECT signal_bucket, count(*) AS n FROM ({BUCKETS}) GROUP BY 1")
def signal_buckets(spark, sf_dir):
    return cues.apply_policy(cue_table(spark, sf_dir)).groupBy("signal_bucket").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT doc_id, signal_bucket, t.tier AS compound_tier, t.tier IN ('high_confidence', 'medium_confidence') AS compound_flag_v2, t.p AS compound_tier_precision_est
FROM ({BUCKETS}) JOIN (VALUES ('both_signals', 'high_confidence', 0.975::DOUBLE), ('caption_letter_and_word', 'high_confidence', 1.0), ('caption_letter_only', 'high_confidence', 0.925),
 ('aspect_only', 'medium_confidence', 0.825), ('caption_word_only', 'rejected', 0.575), ('unflagged', 'not_flagged', NULL)) t(b, tier, p) ON b = signal_bucket"""
)
def tier_policy(spark, sf_dir):
    return cues.apply_policy(cue_table(spark, sf_dir)).select("doc_id", "signal_bucket", "compound_tier", "compound_flag_v2", "compound_tier_precision_est")


@query(f"SELECT signal_bucket, count(*) AS reviewed, round(avg(quality), 6) AS precision FROM ({BUCKETS}) JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1")
def bucket_precision(spark, sf_dir):
    reviewed = cues.apply_policy(cue_table(spark, sf_dir)).join(table(spark, sf_dir, "labels"), "doc_id")
    return cues.bucket_precision(reviewed, "signal_bucket", "quality").withColumn("precision", F.round("precision", 6))


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 40")
def stratified_review_sample(spark, sf_dir):
    return sampling.stratified(table(spark, sf_dir, "documents"), "lang", 40, "doc_id").select("doc_id", "lang")


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 60")
def seeded_sample(spark, sf_dir):
    return sampling.sample_n(table(spark, sf_dir, "documents").select("doc_id"), 60, "doc_id")


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) > 25 AS late FROM documents) ORDER BY late, md5('42:' || doc_id), doc_id LIMIT 150")
def backfill_sample(spark, sf_dir):
    return sampling.stratified_backfill(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 25, 150, "doc_id")


@query("SELECT source FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1) ORDER BY n DESC, source LIMIT 5")
def example_groups(spark, sf_dir):
    return sampling.preferred_groups(table(spark, sf_dir, "documents"), "source", 3, 5).select("source")


@query(
    """WITH s AS (SELECT page_id, url, 'PMC' || page_id AS pmc, CASE page_id % 5 WHEN 0 THEN '00001-PMC' || page_id WHEN 1 THEN 'PMC' || page_id || '__fig-1' WHEN 2 THEN '00002-PMC' || page_id || '-x__fig__2' ELSE '00003-PMC' || page_id || '__fig' END AS stem FROM pages),
 h AS (SELECT *, split_part(stem, '__', 1) AS head FROM s)
SELECT page_id, CASE WHEN contains(stem, '__') AND contains(head, '-') THEN substr(head, strpos(head, '-') + 1) END AS key, coalesce(pmc, '') || '||' || coalesce(url, '') || '||' AS item_key FROM h"""
)
def stem_key_parse(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    pmc = F.concat(F.lit("PMC"), F.col("page_id").cast("string"))
    kind = F.col("page_id") % 5
    stem = (
        F.when(kind == 0, F.concat(F.lit("00001-"), pmc))
        .when(kind == 1, F.concat(pmc, F.lit("__fig-1")))
        .when(kind == 2, F.concat(F.lit("00002-"), pmc, F.lit("-x__fig__2")))
        .otherwise(F.concat(F.lit("00003-"), pmc, F.lit("__fig")))
    )
    return pages.select("page_id", key_from_stem(stem).alias("key"), composite_key(pmc, F.col("url"), F.lit(None)).alias("item_key"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total_k FROM events GROUP BY 1")
def json_props_scan(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k long")["k"])
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total_k"))


@query("SELECT CAST(conv_id AS VARCHAR) AS pmcid, role || '-' || turn AS url, text AS caption, role AS label FROM conversations")
def nested_explode(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    image = F.struct(F.concat_ws("-", "role", F.col("turn").cast("string")).alias("url"), F.col("text").alias("caption"), F.col("role").alias("label"))
    articles = turns.groupBy(F.col("conv_id").cast("string").alias("pmcid")).agg(F.collect_list(image).alias("images")).withColumn("article_url", F.lit(None).cast("string"))
    return readers.flatten_articles(articles).select("pmcid", "url", "caption", "label")


@query("SELECT d.doc_id FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
def resume_anti_join(spark, sf_dir):
    return joins.pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id")


@query("SELECT source, count(*) AS n_new FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 1 GROUP BY 1")
def incremental_new_rows(spark, sf_dir):
    done = table(spark, sf_dir, "labels").filter("quality = 1")
    return joins.pending(table(spark, sf_dir, "documents"), done, ["doc_id"]).groupBy("source").agg(F.count(F.lit(1)).alias("n_new"))


@query("SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def one_to_one_guard(spark, sf_dir):
    return joins.join_one_to_one(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set_intersection(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT o_orderkey AS key, 'only_left' AS side FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey UNION ALL SELECT DISTINCT l_orderkey, 'only_right' FROM lineitem ANTI JOIN orders ON o_orderkey = l_orderkey")
def both_way_missing(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return joins.both_way_missing(orders, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")), "key")


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY sha256(text), doc_id) - 1 AS VARCHAR) AS number FROM documents")
def surrogate_ids(spark, sf_dir):
    numbered = joins.surrogate_ids(hashed(spark, sf_dir).select("doc_id", "source", "sha256"), "source", ["sha256", "doc_id"])
    return numbered.select("doc_id", F.element_at(F.split("figure_id", "__"), -1).alias("number"))


@query(
    """SELECT d.doc_id, CAST(l.quality AS VARCHAR) AS split, true AS listed FROM documents d JOIN (SELECT DISTINCT doc_id, quality FROM labels) l USING (doc_id)
UNION ALL SELECT DISTINCT doc_id, NULL, false FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)"""
)
def listed_splits(spark, sf_dir):
    """Labels as the table of splits: documents without one are listed, none gets a default."""
    splits = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("split"))
    found, missing = joins.split_records(table(spark, sf_dir, "documents").select("doc_id"), splits, ["doc_id"])
    return found.select("doc_id", "split", F.lit(True).alias("listed")).unionByName(missing.select("doc_id", F.lit(None).cast("string").alias("split"), F.lit(False).alias("listed")))


@query(
    """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.lang, 'no match') AS lang_a, coalesce(b.lang, 'no match') AS lang_b, a.n_chars AS n_chars_a, b.n_chars AS n_chars_b
FROM (SELECT * FROM documents WHERE n_chars > 500) a FULL JOIN (SELECT * FROM documents WHERE n_chars < 2000) b USING (doc_id)"""
)
def tracks_by_document(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return joins.tracks_side_by_side(docs.filter("n_chars > 500"), docs.filter("n_chars < 2000"), "doc_id", ["lang", "n_chars"], ("a", "b"))


@query(
    """SELECT doc_id, s_suppkey FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256(coalesce(text, '')), doc_id) AS r FROM documents)
FULL JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS r FROM supplier) USING (r)"""
)
def rows_by_position(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return joins.side_by_position(docs, suppliers, ["h", "doc_id"], ["s_acctbal", "s_suppkey"]).select("doc_id", "s_suppkey")


@query(
    """SELECT click_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.device.os') AS os, coalesce(json_array_length(props, '$.items'), 0)::INTEGER AS n_items,
 coalesce(list_sum(list_transform(json_extract(props, '$.items[*].qty'), lambda q: TRY_CAST(q AS BIGINT))), 0)::BIGINT AS quantity, props IS NOT NULL AND NOT json_valid(props) AS malformed
FROM (SELECT click_id, CASE WHEN json_valid(props) THEN props END AS props, props IS NOT NULL AND NOT json_valid(props) AS bad FROM clicks)""".replace("props IS NOT NULL AND NOT json_valid(props) AS malformed", "bad AS malformed")
)
def click_properties(spark, sf_dir):
    good, broken = readers.parse_records(table(spark, sf_dir, "clicks").select("click_id", "props"), "props")
    get = lambda path, kind: F.try_variant_get("record", path, kind)
    items = get("$.items", "array<struct<sku: bigint, qty: bigint>>")
    quantity = F.aggregate(F.coalesce(items, F.array().cast("array<struct<sku: bigint, qty: bigint>>")), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["qty"], F.lit(0)))
    fields = {"k": get("$.k", "bigint"), "os": get("$.device.os", "string"), "n_items": F.coalesce(F.size(items), F.lit(0)), "quantity": quantity}
    kept = good.select("click_id", *(c.alias(n) for n, c in fields.items()), F.lit(False).alias("malformed"))
    return kept.unionByName(broken.select("click_id", F.lit(0).alias("n_items"), F.lit(0).cast("long").alias("quantity"), F.lit(True).alias("malformed")), allowMissingColumns=True)


# The encoder stands for a model: three numbers of a text.
@query(
    """SELECT doc_id, coalesce(text IN (SELECT text FROM documents WHERE lang = 'en' AND text IS NOT NULL), false) AS was_cached, round(length(text)::DOUBLE, 3) AS a, round(length(replace(text, ' ', ''))::DOUBLE, 3) AS b
FROM documents"""
)
def cached_embeddings(spark, sf_dir):
    """All documents ask a cache that the English ones have filled."""
    name = f"embeddings_{uuid.uuid4().hex}"
    held = cache.open_cache(spark, name, scratch_folder(spark, name), "array<double>", 16)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")

    def encode(df):
        return df.select("key", F.array(F.length("text").cast("double"), F.length(F.replace("text", F.lit(" "), F.lit(""))).cast("double")).alias("embedding"))

    cache.embed_cached(docs.filter("lang = 'en'"), held, encode, "numbers-1")
    out = cache.embed_cached(docs, held, encode, "numbers-1")
    return out.select("doc_id", "was_cached", F.col("embedding")[0].alias("a"), F.col("embedding")[1].alias("b"))
