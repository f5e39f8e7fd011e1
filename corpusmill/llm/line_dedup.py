"""Line dedup with a log-template tree.

Lines are sorted into the leaves of a tree of fixed depth: first by their
number of tokens, then by their leading tokens.  Inside a leaf, tokens that
recur at their place in several lines of different documents or forms are constant; all others
are variable fields, as are tokens with digits.  A line whose constant share is
high enough has a template: its leaf and its constant tokens.  Templates that
recur in several different documents are dropped from all but the first.

Beside the tree, what is equal recurs in fewer documents: whole lines of
``min_tokens`` (token for token; with digits, letter for letter), and sentences
of at least ``min_sentence`` words between blanks inside lines (letter for
letter), so a passage is found wherever it stands in a line.  Of such a line
only the sentences go; a line without any left goes.

Edge cases: a null text stays null with no lines; blank lines are never
dropped; equal documents count as one, so copies do not make their own lines
recur and all lose the same; ids may be null; very long lines are split and
matched in one pass; passages in scripts without blanks are no units, as tokens
and words end at blanks; an empty table gives an empty result; an empty leaf cannot occur; lines end at
line feeds, sentences at a full stop, question or exclamation mark and a blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.plans.scratch import materialize

DEPTH = 3
MIN_DOCS = 3
MIN_EQUAL_DOCS = 2
MIN_CONSTANT = 0.7
MIN_TOKENS = 3
MIN_SENTENCE = 8
STOPS = ".!?"
SPACE = "[ \\t\\x0B\\f\\r]+"
NOT_SPACE = "[^ \\t\\x0B\\f\\r\\n]"
FIELD = "<*>"


def masked(text: Column) -> Column:
    """A text with every token that holds a digit replaced by a field mark.

    A match begins at a token's start and never goes back, so a run of any length is read once.
    """
    return F.when(text.rlike("[0-9]"), F.regexp_replace(text, f"(?<!{NOT_SPACE})[^0-9 \\t\\x0B\\f\\r\\n]*+[0-9]{NOT_SPACE}*+", FIELD)).otherwise(text)


def tokens_of(line: Column) -> Column:
    """The tokens of a masked line, in order; a blank line has none."""
    return F.array_remove(F.split(line, SPACE), "")


def token_lines(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """(keep, line_no, tokens) of all lines.

    Generators keep the optimiser from computing the tokens once for each use of them.
    """
    lines = df.select(*keep, F.posexplode_outer(F.split(masked(F.col(text)), "\n")).alias("line_no", "line"))
    return lines.select(*keep, "line_no", F.explode_outer(F.array(tokens_of(F.col("line")))).alias("tokens"))


def sentences_of(line: Column) -> Column:
    """The sentences of a line, without the blanks between them."""
    for mark in STOPS:
        line = F.replace(line, F.lit(f"{mark} "), F.lit(f"{mark}\n"))
    return F.split(line, "\n")


def _counted(table: DataFrame, keys: list[str], place: Column, *more: str) -> DataFrame:
    """(keys, docs, at, more) over a table with ``print``: the number of different texts, and the first place.

    Counted in two steps, so a very frequent key reaches its task as one row for each task before.
    """
    first = [F.first(c).alias(c) for c in more]
    by_text = table.groupBy(*keys, "print").agg(F.min(place).alias("at"), *first)
    return by_text.groupBy(*keys).agg(F.count(F.lit(1)).alias("docs"), F.min("at").alias("at"), *first)


def stays(first: str, *numbers: str) -> Column:
    """Whether a row is the first place, or the same place in a copy of that text."""
    return F.col("print").eqNullSafe(F.col(f"{first}.print")) & (F.struct(*(F.col(c) for c in numbers or ("line_no",))) == F.struct(*(F.col(f"{first}.{c}").alias(c) for c in numbers or ("line_no",))))


def line_decisions(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = DEPTH,
    min_docs: int = MIN_DOCS,
    min_constant: float = MIN_CONSTANT,
    min_tokens: int = MIN_TOKENS,
    min_equal_docs: int = MIN_EQUAL_DOCS,
    min_sentence: int = MIN_SENTENCE,
) -> DataFrame:
    """(id, print, line_no, sentence_no, first) of the lines (sentence -1) and sentences that recur; numbers start at 0.

    ``first`` marks the occurrence that stays: the smallest (id, print, number), in all copies of its text, so copies
    stay equal.  ``print`` is the text's hash.
    Lines travel as hashes of their tokens, two for each decision; of equal lines one is read again, from the text of
    its first document.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text")).filter("text is not null")
    lines = token_lines(rows, ["id", "print"], "text").filter(F.size("tokens") >= min_tokens)
    leaf = F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth))
    plain = ~F.array_contains("tokens", FIELD)
    lines = materialize(lines.select("id", "print", "line_no", leaf.alias("leaf"), F.xxhash64("tokens").alias("form"), plain.alias("plain")), "lines")

    # equal lines are counted first, so a very frequent one is a single row when its leaf is joined
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "print", "line_no")
    forms = materialize(_counted(lines, ["leaf", "form"], place, "plain"), "forms")
    # leaves that too few different documents reach cannot hold a recurring template
    reached = forms.groupBy("leaf").agg(F.sum("docs").alias("leaf_docs")).filter(F.col("leaf_docs") >= min_docs).select("leaf")
    wanted = forms.join(reached, "leaf").groupBy(F.col("at.id").alias("its_id"), F.col("at.print").alias("its_print")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("at.line_no"), F.struct("leaf", "form", "docs")))).alias("wanted")
    )
    # the hashed side holds a few numbers for a document, so the texts stream through the join unsorted
    met = rows.join(wanted.hint("shuffle_hash"), (F.col("print") == F.col("its_print")) & F.col("id").eqNullSafe(F.col("its_id")))
    read = token_lines(met, ["wanted"], "text").select(F.col("wanted")[F.col("line_no")].alias("it"), "tokens")
    read = read.filter("it is not null").select("it.leaf", "it.form", "it.docs", "tokens").dropDuplicates(["leaf", "form"])
    cells = read.select("leaf", "form", "docs", F.size("tokens").alias("width"), F.posexplode("tokens").alias("place", "token")).filter(F.col("token") != FIELD)
    cells = materialize(cells.select("leaf", "form", "docs", "width", F.xxhash64("place", "token").alias("cell")), "cells")
    constant = materialize(cells.groupBy("leaf", "cell").agg(F.sum("docs").alias("seen")).filter(F.col("seen") >= min_docs).select("leaf", "cell"), "constant")
    skeletons = (
        cells.join(constant, ["leaf", "cell"])
        .groupBy("leaf", "form", "width")
        .agg(F.count(F.lit(1)).alias("constants"), F.bit_xor("cell").alias("mark"))
        .filter(F.col("constants") >= F.col("width") * F.lit(min_constant))
        .select("leaf", "form", "mark")
    )
    # lines without digits are equal when their forms are
    equal = forms.filter(F.col("plain") & (F.col("docs") >= min_equal_docs)).select("leaf", "form", F.col("at").alias("equal_place"))
    keyed = materialize(equal.join(skeletons, ["leaf", "form"], "full"), "keyed")
    found = materialize(lines.join(keyed, ["leaf", "form"]).select("id", "print", "line_no", "leaf", "mark", "equal_place"), "templates")
    # written first: a join on the aggregation's own partitioning could not be split for a very frequent template
    recurring = _counted(found.filter("mark is not null"), ["leaf", "mark"], place).filter(F.col("docs") >= min_docs)
    recurring = materialize(recurring.select("leaf", "mark", F.col("at").alias("first_place")), "recurring")
    by_template = found.filter("mark is not null").join(recurring, ["leaf", "mark"]).select("id", "print", "line_no", stays("first_place").alias("first"))
    by_form = found.filter("equal_place is not null").select("id", "print", "line_no", stays("equal_place").alias("first"))
    of_lines = by_template.union(by_form).select("id", "print", "line_no", F.lit(-1).alias("sentence_no"), "first")

    # sentences, and whole lines with digits, by the hashes of their letters
    cut = rows.select("id", "print", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    parts = cut.select("id", "print", "line_no", F.posexplode(sentences_of(F.col("line"))).alias("sentence_no", "part"))
    numbered = cut.filter(F.col("line").rlike("[0-9]")).select("id", "print", "line_no", F.lit(-1).alias("sentence_no"), F.col("line").alias("part"))
    blanks = F.length("part") - F.length(F.replace("part", F.lit(" "), F.lit("")))
    units = parts.filter(blanks >= min_sentence - 1).union(numbered.filter(blanks >= min_tokens - 1))
    units = materialize(units.select("id", "print", "line_no", "sentence_no", F.xxhash64("part").alias("e"), F.hash("part").alias("f")), "units")
    # one text or several: the ends of the range of their hashes tell
    key = ["e", "f", "is_line"]
    units = units.withColumn("is_line", F.col("sentence_no") < 0)
    if min_equal_docs == 2:
        repeated = units.groupBy(*key).agg(F.min("print").alias("low"), F.max("print").alias("high")).filter("low < high")
    else:
        repeated = units.select(*key, "print").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_equal_docs)
    alike = materialize(units.join(materialize(repeated.select(*key), "repeated"), key), "alike")
    spot = F.struct(F.col("id").isNull().alias("no_id"), "id", "print", "line_no", "sentence_no")
    firsts = materialize(alike.groupBy(*key).agg(F.min(spot).alias("first_spot")), "firsts")
    of_units = alike.join(firsts, key).select("id", "print", "line_no", "sentence_no", stays("first_spot", "line_no", "sentence_no").alias("first"))
    return of_lines.union(of_units).groupBy("id", "print", "line_no", "sentence_no").agg(F.min("first").alias("first"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), **options) -> DataFrame:
    """(doc_id, text, n_lines, n_recurring, n_dropped, n_cut) for every row, and the columns in ``keep``.

    ``text`` is without the dropped lines and cut sentences; ``n_recurring`` counts recurring lines with their first
    occurrences, which stay, and ``n_cut`` the sentences that go.  The texts are shuffled once, to meet the decisions,
    which are a few numbers for each document.
    """
    found = line_decisions(docs, id_col, text_col, **options)
    is_line, gone = F.col("sentence_no") < 0, ~F.col("first")
    at = F.col("line_no").cast("long") * F.lit(2**31) + F.col("sentence_no")
    marks = found.groupBy("id", "print").agg(
        F.count_if(is_line).alias("recurring"), F.collect_list(F.when(is_line & gone, F.col("line_no"))).alias("gone"), F.collect_list(F.when(~is_line & gone, at)).alias("cuts")
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("whole"), F.xxhash64(text_col).alias("its_print"), *(F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep)))
    met = rows.join(marks.hint("shuffle_hash"), (F.col("its_print") == F.col("print")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    lines = F.split("whole", "\n")
    gone, cuts = F.coalesce("gone", F.array().cast("array<int>")), F.coalesce("cuts", F.array().cast("array<bigint>"))
    cut_lines = F.transform(cuts, lambda c: F.shiftright(c, 31).cast("int"))

    def without(line: Column, i: Column) -> Column:
        rest = F.array_join(F.transform(sentences_of(line), lambda p, j: F.when(~F.array_contains(cuts, i.cast("long") * F.lit(2**31) + j), p)), " ")
        return F.when(F.trim(rest) != "", rest)

    kept = F.transform(lines, lambda x, i: F.when(F.array_contains(gone, i), F.lit(None)).when(F.array_contains(cut_lines, i), without(x, i)).otherwise(x))
    kept = F.when((F.size(gone) > 0) | (F.size(cuts) > 0), F.array_join(kept, "\n"))  # leaves nulls out
    met = met.select(
        "*",
        F.size(gone).alias("n_gone"),
        F.size(F.filter(cuts, lambda c: ~F.array_contains(gone, F.shiftright(c, 31).cast("int")))).alias("n_parts"),
        F.explode(F.array(kept)).alias("rest"),
    )
    return met.select(
        "doc_id",
        F.coalesce("rest", "whole").alias("text"),
        F.when(F.col("whole").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce("recurring", F.lit(0)).cast("long").alias("n_recurring"),
        F.col("n_gone").cast("long").alias("n_dropped"),
        F.col("n_parts").cast("long").alias("n_cut"),
        *(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)),
    )


def deduped_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with their texts after line dedup, in the columns of ``docs``; those that lose all lines go."""
    # the other columns travel as one, so their names clash with nothing
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    packed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(F.lit(0), *(F.col(f"`{c}`") for c in rest)).alias("row"))
    changed = (F.col("n_dropped") > 0) | (F.col("n_cut") > 0)
    out = line_dedup(packed, keep=("row",), **options).filter(~changed | (F.col("text") != ""))
    names = {id_col: F.col("doc_id"), text_col: F.col("text")} | {c: F.col("row").getField(c) for c in rest}
    if "n_chars" in rest:
        n_chars = F.when(changed, F.length("text")).otherwise(names["n_chars"])
        names["n_chars"] = n_chars.cast(dict(docs.dtypes)["n_chars"])
    return out.select(*(names[c].alias(c) for c in docs.columns))


def line_dedup_sql() -> str:
    """DuckDB SQL for :func:`line_dedup` over ``documents`` with the default parameters."""
    space = r"[ \t\x0B\f\r]+"
    return f"""
WITH docs AS (SELECT doc_id, text, row_number() OVER () AS row_no FROM documents),
split AS (SELECT doc_id, text, row_no, string_split(text, chr(10)) AS lines FROM docs),
numbered AS (SELECT doc_id, text, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS line_no FROM (SELECT DISTINCT doc_id, text, lines FROM split WHERE text IS NOT NULL)),
tokenised AS (
  SELECT doc_id, text, line_no,
    list_transform(list_filter(regexp_split_to_array(line, '{space}'), lambda t: t <> ''), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '{FIELD}' ELSE t END) AS tokens
  FROM numbered),
lines AS (SELECT *, len(tokens) AS width, tokens[1:{DEPTH}] AS lead FROM tokenised WHERE len(tokens) >= {MIN_TOKENS}),
reached AS (SELECT width, lead FROM lines GROUP BY ALL HAVING count(DISTINCT text) >= {MIN_DOCS}),
busy AS (SELECT l.* FROM lines l SEMI JOIN reached r ON l.width = r.width AND l.lead = r.lead),
cells AS (SELECT * FROM (SELECT doc_id, text, line_no, width, lead, tokens, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM busy) WHERE token <> '{FIELD}'),
constant AS (SELECT width, lead, place, token FROM cells GROUP BY ALL HAVING count(DISTINCT (text, tokens)) >= {MIN_DOCS}),
skeletons AS (
  SELECT c.doc_id, c.text, c.line_no, c.width, c.lead, string_agg(c.place || ':' || c.token, ' ' ORDER BY c.place) AS mark
  FROM cells c JOIN constant k ON c.width = k.width AND c.lead = k.lead AND c.place = k.place AND c.token = k.token
  GROUP BY ALL HAVING count(*) >= c.width * {MIN_CONSTANT}),
recurring AS (SELECT width, lead, mark FROM skeletons GROUP BY ALL HAVING count(DISTINCT text) >= {MIN_DOCS}),
placed AS (
  SELECT s.doc_id, s.text, s.line_no, NOT (s.text = first_value(s.text) OVER w AND s.line_no = first_value(s.line_no) OVER w) AS later
  FROM skeletons s SEMI JOIN recurring r ON s.width = r.width AND s.lead = r.lead AND s.mark = r.mark
  WINDOW w AS (PARTITION BY s.width, s.lead, s.mark ORDER BY s.doc_id NULLS LAST, s.text, s.line_no)),
parts AS (
  SELECT doc_id, text, line_no, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS sentence_no FROM (
    SELECT doc_id, text, line_no, string_split(replace(replace(replace(line, '. ', '.' || chr(10)), '! ', '!' || chr(10)), '? ', '?' || chr(10)), chr(10)) AS parts FROM numbered)),
units AS (
  SELECT doc_id, text, line_no, -1 AS sentence_no, list_filter(regexp_split_to_array(line, '{space}'), lambda t: t <> '') AS tokens, line AS part FROM numbered
  UNION ALL SELECT doc_id, text, line_no, sentence_no, NULL, part FROM parts),
long AS (
  SELECT doc_id, text, line_no, sentence_no, sentence_no < 0 AS is_line, CASE WHEN sentence_no < 0 AND NOT regexp_matches(part, '[0-9]') THEN array_to_string(tokens, ' ') ELSE part END AS raw,
  FROM units WHERE CASE WHEN sentence_no >= 0 THEN length(part) - length(replace(part, ' ', '')) >= {MIN_SENTENCE} - 1
    WHEN regexp_matches(part, '[0-9]') THEN length(part) - length(replace(part, ' ', '')) >= {MIN_TOKENS} - 1 ELSE len(tokens) >= {MIN_TOKENS} END),
alike AS (
  SELECT doc_id, text, line_no, sentence_no,
    NOT (text = first_value(text) OVER w AND line_no = first_value(line_no) OVER w AND sentence_no = first_value(sentence_no) OVER w) AS later
  FROM long SEMI JOIN (SELECT raw, is_line FROM long GROUP BY ALL HAVING count(DISTINCT text) >= {MIN_EQUAL_DOCS}) r ON long.raw = r.raw AND long.is_line = r.is_line
  WINDOW w AS (PARTITION BY long.raw, long.is_line ORDER BY doc_id NULLS LAST, text, line_no, sentence_no)),
decided AS (
  SELECT doc_id, text, line_no, sentence_no, bool_or(later) AS gone
  FROM (SELECT * FROM alike UNION ALL SELECT doc_id, text, line_no, -1, later FROM placed) GROUP BY 1, 2, 3, 4),
lost AS (SELECT doc_id, text, line_no FROM decided WHERE gone AND sentence_no < 0),
cuts AS (SELECT doc_id, text, line_no, sentence_no FROM decided WHERE gone AND sentence_no >= 0),
changed AS (
  SELECT n.doc_id, n.text, n.line_no, CASE WHEN l.line_no IS NULL THEN CASE WHEN c.some THEN nullif(CASE WHEN trim(c.rest, ' ') = '' THEN '' ELSE c.rest END, '') ELSE n.line END END AS line
  FROM (SELECT * FROM numbered SEMI JOIN decided USING (doc_id, text)) n
  LEFT JOIN lost l ON n.doc_id = l.doc_id AND n.text = l.text AND n.line_no = l.line_no
  LEFT JOIN (
    SELECT p.doc_id, p.text, p.line_no, true AS some, coalesce(string_agg(CASE WHEN x.sentence_no IS NULL THEN p.part END, ' ' ORDER BY p.sentence_no), '') AS rest
    FROM (SELECT * FROM parts SEMI JOIN cuts USING (doc_id, text, line_no)) p
    LEFT JOIN cuts x USING (doc_id, text, line_no, sentence_no) GROUP BY 1, 2, 3) c ON n.doc_id = c.doc_id AND n.text = c.text AND n.line_no = c.line_no),
joined AS (SELECT doc_id, text, coalesce(string_agg(line, chr(10) ORDER BY line_no), '') AS kept FROM changed GROUP BY 1, 2),
marks AS (
  SELECT doc_id, text, count(*) FILTER (d.sentence_no < 0) AS recurring, count(*) FILTER (d.gone AND d.sentence_no < 0) AS dropped,
    count(*) FILTER (d.gone AND d.sentence_no >= 0 AND l.line_no IS NULL) AS cut
  FROM decided d LEFT JOIN lost l USING (doc_id, text, line_no) GROUP BY 1, 2)
SELECT s.doc_id, CASE WHEN m.dropped + m.cut > 0 THEN j.kept ELSE s.text END AS text,
  CAST(coalesce(len(s.lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(m.recurring, 0) AS BIGINT) AS n_recurring,
  CAST(coalesce(m.dropped, 0) AS BIGINT) AS n_dropped, CAST(coalesce(m.cut, 0) AS BIGINT) AS n_cut
FROM split s LEFT JOIN marks m ON s.doc_id IS NOT DISTINCT FROM m.doc_id AND s.text = m.text
LEFT JOIN joined j ON s.doc_id IS NOT DISTINCT FROM j.doc_id AND s.text = j.text
"""
