"""License scans: sparse TF-IDF against templates, then inheritance along directories.

Every line, every paragraph (a header may be wrapped over several lines) and
the whole of a text is a sparse TF-IDF vector, with 1 + ln(n) for n occurrences;
its cosine to every template decides the licence.  Document frequencies of all
terms are counted over all documents.  Only units that could match are scored:
for every template a unit must hold one of its heaviest terms (as many as leave
the rest too light to reach the threshold) and as many of its terms as the
threshold needs at least, so no unit that could match is left out.  A document
without a licence of its own takes that of the nearest ancestor directory with
a licence file, one that is named so.  What such a file passes on is its own
best licence; a page that is little more than a notice keeps that to itself.

Edge cases: null and empty texts hold no terms; documents without a path have
no directory and inherit nothing; the strongest kind of template wins (weak are
clauses that several licences share, weakest a bare reservation of rights),
then the best cosine, then the smallest name; of several licence files of a
directory the best counts, then the smallest path and id; repeated rows give
repeated rows; very long texts, runs of blank lines and of dots are matched in
one pass; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.plans.scratch import materialize, remove

UNIT_COSINE = 0.6
FILE_COSINE = 0.7
NOTICE_TERMS = 1.5  # times the different terms of a template, for a whole text
TERM = "[^a-z0-9.]+"
BEFORE, AFTER = "(?<![a-z0-9.])", "(?![a-z0-9])"
PARAGRAPH = "\\n(?:[^a-zA-Z0-9\\n]*+\\n)++"  # possessive: other repeated groups recurse for each blank line
FILE_NAME = "(?i)^(un)?licen[cs]e|^copying|^notice"

# Public licence texts, their standard notices and titles, by SPDX identifier.
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_CLAUSES = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution."
)
BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
GNU_NOTICE = (
    "This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the "
    "Free Software Foundation{stop} either version {version} of the License, or (at your option) any later version."
)
TEMPLATES = (
    ("AGPL-3.0-only", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, version 3."),
    ("AGPL-3.0-only", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0-or-later", GNU_NOTICE.format(what="program", mark=":", kind="Affero ", stop=",", version="3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", f"{BSD_OPENING} {BSD_CLAUSES}"),
    ("BSD-3-Clause", f"{BSD_OPENING} {BSD_CLAUSES} {BSD_NAMES}"),
    ("BSD-3-Clause", BSD_NAMES),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0, the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0, the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0-only", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0-or-later", GNU_NOTICE.format(what="program", mark=";", kind="", stop=";", version="2")),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-only", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0-or-later", GNU_NOTICE.format(what="program", mark=":", kind="", stop=",", version="3")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1-only", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1-or-later", GNU_NOTICE.format(what="library", mark=";", kind="Lesser ", stop=";", version="2.1")),
    ("LGPL-3.0-only", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0-only", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0-or-later", GNU_NOTICE.format(what="library", mark=":", kind="Lesser ", stop=",", version="3")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MIT", MIT_GRANT),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)
# Weak templates: what several licences share, and what grants nothing.
SHARED = (("BSD-2-Clause", BSD_OPENING),)
RESERVED = (("LicenseRef-all-rights-reserved", "All rights reserved."),)


def _terms(text: str) -> list[str]:
    """The terms of a template: lower case, ASCII letters, digits and inner full stops."""
    out, held = [], ""
    for c in [*text.lower(), " "]:
        if c in "abcdefghijklmnopqrstuvwxyz0123456789.":
            held += c
        else:
            out.append(held.rstrip("."))
            held = ""
    return [t for t in out if t.lstrip(".")]


def terms_of(text: Column) -> Column:
    """The terms of a text as an array, in the form of the templates' terms."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "(?<![.])[.]++(?![a-z0-9])", " ")
    return F.array_remove(F.split(bare, TERM), "")


def trie_pattern(words: set[str]) -> str:
    """A regular expression for any of the words that looks at each letter once."""
    tree: dict = {}
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        branches = [re.escape(c) + pattern(node[c]) for c in sorted(node) if c]
        if not branches:
            return ""
        return f"(?:{'|'.join(branches)})" + ("?" if "" in node else "")

    return pattern(tree)


Form = tuple[str, int, dict[str, int]]


def templates(extra: dict[str, str] | None = None) -> list[Form]:
    """(licence, weakness, term counts) of all templates; ``extra`` are further texts by name."""
    tables = ((TEMPLATES, 0), (tuple((extra or {}).items()), 0), (SHARED, 1), (RESERVED, 2))
    return [(name, weak, {t: terms.count(t) for t in terms}) for table, weak in tables for name, terms in ((n, _terms(x)) for n, x in table)]


def document_frequencies(docs: DataFrame, text_col: str) -> DataFrame:
    """(term, df): in how many documents each term occurs, counted over all documents before the shuffle and after."""
    return docs.select(F.explode(F.array_distinct(terms_of(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _weights(terms: dict[str, int], idf: dict[str, float]) -> dict[str, float]:
    """A template's unit vector."""
    values = {t: (1 + math.log(n)) * idf[t] for t, n in terms.items()}
    norm = math.sqrt(sum(v * v for v in values.values()))
    return {t: v / norm for t, v in values.items()}


def _best(units: DataFrame, keys: list[str], frequencies: DataFrame, total: int, idf: dict[str, float], forms: list[Form], limit: Column) -> DataFrame:
    """(keys, licence, weak, cosine): every unit's best template at or above its limit.  ``units`` has the keys and ``terms``.

    A whole text (unit 0) must not have many more different terms than the template, else it is more than a notice.
    """
    spark = units.sparkSession
    rows = [(i, name, weak, int(NOTICE_TERMS * len(terms)), t, w) for i, (name, weak, terms) in enumerate(forms) for t, w in _weights(terms, idf).items()]
    weights = F.broadcast(spark.createDataFrame(rows, "form int, licence string, weak int, most int, term string, weight double"))
    counted = units.select(*keys, F.explode("terms").alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))
    valued = counted.join(frequencies, "term").withColumn("value", (1 + F.log(F.col("n").cast("double"))) * (F.log(F.lit(1.0 + total) / (1 + F.col("df"))) + 1))
    valued = materialize(valued.select(*keys, "term", "value"), "valued")
    norms = valued.groupBy(*keys).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"), F.count(F.lit(1)).alias("terms"))
    dots = valued.join(weights, "term").groupBy(*keys, "form", "licence", "weak", "most").agg(F.sum(F.col("value") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, keys).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).filter((F.col("cosine") >= limit) & ((F.col("unit") > 0) | (F.col("terms") <= F.col("most"))))
    best = F.min_by(F.struct("licence", "weak", "cosine"), F.struct("weak", -F.col("cosine"), "licence")).alias("best")
    out = materialize(scored.groupBy(*keys).agg(best).select(*keys, "best.*"), "scored")
    remove(valued)
    return out


def anchors(forms: list[Form], idf: dict[str, float], threshold: float) -> set[str]:
    """Terms of which a vector must hold one to reach the threshold with any template (by Cauchy-Schwarz)."""
    out: set[str] = set()
    for _, _, terms in forms:
        rest = 0.0
        for t, w in sorted(_weights(terms, idf).items(), key=lambda x: (x[1], x[0])):
            rest += w * w
            if rest >= threshold**2 - 1e-9:
                out.add(t)
    return out


def least_terms(terms: dict[str, int], idf: dict[str, float], threshold: float) -> int:
    """How many of a template's terms a vector must hold at least to reach the threshold."""
    held = 0.0
    for n, w in enumerate(sorted(_weights(terms, idf).values(), reverse=True), 1):
        held += w * w
        if held >= threshold**2 - 1e-9:
            return n
    return len(terms)


def parents_of(path: Column) -> Column:
    """All ancestor directories of a path, the nearest last; a path without a separator has none."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat_ws("/", F.slice(parts, 1, n))))


def scan_licenses(
    docs: DataFrame,
    path: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    extra: dict[str, str] | None = None,
    unit_cosine: float = UNIT_COSINE,
    file_cosine: float = FILE_COSINE,
) -> DataFrame:
    """(doc_id, path, licence, cosine, origin, directory) for every row.

    ``origin`` is 'file' for a licence file, 'notice' for a text that is little more than one, 'header' for a licence inside
    a text, or 'inherited' (null without a licence); ``directory`` is where an inherited licence
    was found.  Only units that could match, counts of terms, keys and directories are shuffled, never the other text.
    ``extra`` adds templates by name, such as whole licence texts.
    """
    forms = templates(extra)
    frequencies = materialize(document_frequencies(docs, text_col), "frequencies")
    total = docs.count()
    known = sorted({t for _, _, terms in forms for t in terms})
    spark = docs.sparkSession
    found = frequencies.join(F.broadcast(spark.createDataFrame([(t,) for t in known], "term string")), "term", "left_semi")
    df = {r.term: r.df for r in found.collect()}  # one row for each term of the templates at most
    idf = {t: math.log((1 + total) / (1 + df.get(t, 0))) + 1 for t in known}
    threshold = min(unit_cosine, file_cosine)
    pattern = BEFORE + trie_pattern(anchors(forms, idf, threshold)) + AFTER
    rows = docs.select(F.col(id_col).alias("doc_id"), path.alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = F.md5(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("path", F.lit("-")), "text"))
    low = F.lower("text")
    holding = rows.filter(low.rlike(pattern))
    # unit 0 is the whole text, the others are its lines and paragraphs
    parts = F.concat(F.array("text"), F.split("text", "\n"), F.split("text", PARAGRAPH))
    units = holding.select(key.alias("row"), F.posexplode(F.array_distinct(parts)).alias("unit", "part")).filter(F.lower("part").rlike(pattern))
    units = units.select("row", "unit", F.explode(F.array(terms_of(F.col("part")))).alias("terms"))
    could = F.lit(False)
    literals = lambda words: F.array(*(F.lit(t) for t in sorted(words)))
    for form in forms:
        enough = F.size(F.array_intersect("terms", literals(form[2]))) >= least_terms(form[2], idf, threshold)
        could = could | (F.arrays_overlap("terms", literals(anchors([form], idf, threshold))) & enough)
    units = materialize(units.filter(could).dropDuplicates(["row", "unit"]), "units")
    limit = F.when(F.col("unit") == 0, F.lit(file_cosine)).otherwise(F.lit(unit_cosine))
    scored = _best(units, ["row", "unit"], frequencies, total, idf, forms, limit)
    own = scored.groupBy("row").agg(
        F.min_by(F.struct("licence", "cosine", "weak"), F.struct("weak", -F.col("cosine"), "licence", "unit")).alias("best"),
        F.max(F.col("unit") == 0).alias("is_notice"),
    )
    own = materialize(own, "licences")
    keyed = materialize(rows.select("doc_id", "path", key.alias("row"), F.element_at(parents_of(F.col("path")), -1).alias("directory")), "paths")
    marked = materialize(keyed.join(own, "row", "left"), "marked")
    remove(frequencies, units, scored, own, keyed)

    named = F.element_at(F.split("path", "/"), -1).rlike(FILE_NAME)
    files = marked.filter(F.col("best").isNotNull() & F.col("path").isNotNull() & named)
    place = F.struct(F.col("best.weak"), -F.col("best.cosine"), F.col("path"), F.col("doc_id").isNull(), F.col("doc_id"))
    given = files.filter("directory is not null").groupBy("directory").agg(F.min_by(F.struct("best.licence", "best.cosine"), place).alias("given"))
    # every directory looks for its nearest ancestor once, whatever the number of its documents
    here = marked.filter("best is null and directory is not null").select("directory").distinct()
    above = here.select(F.col("directory").alias("its_directory"), F.posexplode(F.concat(parents_of(F.col("directory")), F.array("directory"))).alias("depth", "directory"))
    top = here.filter(~F.col("directory").contains("/")).select(F.col("directory").alias("its_directory"), F.lit(0).alias("depth"), "directory")
    nearest = above.unionByName(top).join(given, "directory").groupBy("its_directory").agg(F.max_by(F.struct("given", "directory"), "depth").alias("near"))
    nearest = materialize(nearest, "nearest")
    out = marked.join(nearest, F.col("best").isNull() & (F.col("directory") == F.col("its_directory")), "left")
    origin = F.when(F.col("best").isNotNull(), F.when(named, F.lit("file")).when(F.col("is_notice"), F.lit("notice")).otherwise(F.lit("header"))).when(F.col("near").isNotNull(), F.lit("inherited"))
    return out.select(
        "doc_id",
        "path",
        F.coalesce("best.licence", "near.given.licence").alias("licence"),
        F.coalesce("best.cosine", "near.given.cosine").alias("cosine"),
        origin.alias("origin"),
        F.col("near.directory").alias("directory"),
    )


def scan_sql(path: str) -> str:
    """DuckDB SQL for :func:`scan_licenses` over ``documents`` with distinct ids and the default parameters."""
    values = ", ".join(f"({i}, '{name}', {weak}, '{t}', {n})" for i, (name, weak, terms) in enumerate(templates()) for t, n in terms.items())
    return f"""
WITH forms(form, licence, weak, term, n) AS (VALUES {values}),
docs AS MATERIALIZED (SELECT doc_id, {path} AS path, coalesce(text, '') AS text FROM documents),
units AS (SELECT doc_id, unit, line FROM (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS unit FROM (
    SELECT doc_id, [text] || string_split(text, chr(10)) || regexp_split_to_array(text, '\n([^a-zA-Z0-9\n]*\n)+') AS parts FROM docs))),
terms AS MATERIALIZED (SELECT doc_id, unit, term, count(*) AS n FROM (
  SELECT doc_id, unit, unnest(list_transform(regexp_extract_all(lower(line), '[a-z0-9.]+'), lambda t: rtrim(t, '.'))) AS term FROM units) WHERE term <> '' GROUP BY ALL),
total AS (SELECT count(*) AS d FROM docs),
seen AS (SELECT term, count(*) AS df FROM terms WHERE unit = 0 GROUP BY 1),
idfs AS MATERIALIZED (
  SELECT term, ln((1 + d) / (1 + coalesce(df, 0))::DOUBLE) + 1 AS idf FROM (SELECT DISTINCT term FROM forms UNION SELECT term FROM seen) LEFT JOIN seen USING (term), total),
weights AS MATERIALIZED (
  SELECT form, licence, weak, term, v / sqrt(sum(v * v) OVER (PARTITION BY form)) AS w FROM (SELECT *, (1 + ln(n)) * idf AS v FROM forms JOIN idfs USING (term))),
near_units AS (SELECT DISTINCT doc_id, unit FROM terms JOIN weights USING (term)),
valued AS MATERIALIZED (SELECT t.doc_id, t.unit, t.term, (1 + ln(t.n)) * idf AS v FROM terms t JOIN idfs USING (term) SEMI JOIN near_units USING (doc_id, unit)),
norms AS (SELECT doc_id, unit, sqrt(sum(v * v)) AS norm, count(*) AS terms FROM valued GROUP BY 1, 2),
sizes AS (SELECT form, {NOTICE_TERMS} * count(*) AS most FROM forms GROUP BY 1),
scored AS (SELECT doc_id, unit, licence, weak, round(dot / norm, 6) AS cosine, unit > 0 OR terms <= most AS fits FROM (
  SELECT doc_id, unit, form, licence, weak, sum(v * w) AS dot FROM valued JOIN weights USING (term) GROUP BY ALL) JOIN norms USING (doc_id, unit) JOIN sizes USING (form)),
hits AS (SELECT * FROM scored WHERE fits AND cosine >= CASE WHEN unit = 0 THEN {FILE_COSINE} ELSE {UNIT_COSINE} END),
best AS (
  SELECT b.*, f.doc_id IS NOT NULL AS is_notice FROM (
    SELECT doc_id, licence, cosine, weak FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weak, cosine DESC, licence, unit) AS r FROM hits) WHERE r = 1) b
  LEFT JOIN (SELECT DISTINCT doc_id FROM hits WHERE unit = 0) f USING (doc_id)),
named AS (SELECT doc_id, path, regexp_matches(regexp_extract(path, '[^/]*$'), '{FILE_NAME}') AS named FROM docs),
given AS (SELECT directory, licence, cosine FROM (SELECT *, row_number() OVER (PARTITION BY directory ORDER BY weak, cosine DESC, path, doc_id) AS r FROM (
  SELECT regexp_replace(path, '/[^/]*$', '') AS directory, * FROM best JOIN named USING (doc_id) WHERE contains(path, '/') AND named)) WHERE r = 1),
above AS (SELECT doc_id, i AS depth, array_to_string(parts[1:i], '/') AS directory FROM (SELECT doc_id, string_split(path, '/') AS parts FROM docs ANTI JOIN best USING (doc_id)), range(1, 100) r(i) WHERE i < len(parts)),
near AS (SELECT doc_id, g.directory, g.licence, g.cosine FROM (SELECT a.doc_id, max(depth) AS depth FROM above a JOIN given USING (directory) GROUP BY 1) JOIN above a USING (doc_id, depth) JOIN given g ON g.directory = a.directory)
SELECT d.doc_id, d.path, coalesce(b.licence, n.licence) AS licence, coalesce(b.cosine, n.cosine) AS cosine,
  CASE WHEN b.licence IS NOT NULL THEN CASE WHEN m.named THEN 'file' WHEN b.is_notice THEN 'notice' ELSE 'header' END WHEN n.licence IS NOT NULL THEN 'inherited' END AS origin, n.directory
FROM docs d LEFT JOIN best b USING (doc_id) LEFT JOIN named m USING (doc_id) LEFT JOIN near n USING (doc_id)
"""
