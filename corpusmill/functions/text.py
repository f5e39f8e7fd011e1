"""Text expressions: normalisation, segmentation, keyword tags, answer scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cue and marker patterns, and the ordered keyword tables (the first label with a hit wins).
LETTER_MARKER = r"\(([A-Za-z])\)|\b(?:fig(?:ure)?\.?\s*\d*)([a-hA-H])\b"
PANEL_LETTERS = r"\(\s*[a-hA-H]\s*\)"
PANEL_WORD = r"(?i)\b(top|bottom|left|right|upper|lower|inset|panel[s]?)\b"
PANEL_LETTER_LIST = r"(?i)\b[a-h]\b(?:\s*(?:,|and|&)\s*\b[a-h]\b){1,}"
MODALITY_KEYWORDS = {
    "ultrasound": ["ultrasound", "sonograph", "doppler"],
    "MRI": ["mri", "magnetic resonance"],
    "CT": [" ct scan", "computed tomography", "ct imag"],
    "X-ray": ["x-ray", "radiograph"],
    "histopathology": ["histopatholog", "biopsy", "h&e stain", "microscop"],
}
ANATOMY_KEYWORDS = {
    "ovary": ["ovary", "ovarian", "adnexal"],
    "breast": ["breast", "mammary"],
    "uterus": ["uterus", "uterine", "endometri"],
    "cervix": ["cervix", "cervical"],
}

# White space of every script, in a form that Java and RE2 read alike.
SPACE = r"[\s\p{Z}]"
EDGES = rf"^{SPACE}++|(?<!{SPACE}){SPACE}++$"  # a run inside is looked at once, from its start
NON_WORD = r"[^\p{L}\p{N}_\s\p{Z}]"
CUT = "\x01"


def strip(c: Column) -> Column:
    """The text without white space of any script at its ends."""
    return F.regexp_replace(c, EDGES, "")


def non_ascii_ratio(c: Column) -> Column:
    """Share of characters outside ASCII; 1 for null and empty texts."""
    text = F.coalesce(c, F.lit(""))
    n = F.length(text)
    return F.when(n == 0, F.lit(1.0)).otherwise((n - F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))) / n)


def words(c: Column) -> Column:
    """White-space separated tokens of the lower-cased text; none for null and blank texts."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), rf"{SPACE}+"), lambda w: w != "")


def segments(c: Column, marker: str = LETTER_MARKER, ignore_case: bool = False) -> Column:
    """Slices that start at each of at least two markers, stripped, empty ones left out; else the whole stripped text.

    Text before the first marker is not part of any slice.  Blank and null texts give one empty segment.
    """
    pattern = ("(?i)" if ignore_case else "") + marker
    whole = F.array(strip(c))
    marked = F.split(F.regexp_replace(c, f"({pattern})", f"{CUT}$1"), CUT)
    cut = F.filter(F.transform(F.slice(marked, 2, 1_000_000_000), strip), lambda s: s != "")
    several = F.regexp_count(c, F.lit(pattern)) >= 2
    blank = c.isNull() | (strip(c) == "")
    return F.when(blank, F.array(F.lit(""))).when(several & (F.size(cut) > 0), cut).otherwise(whole)


def keyword_case(c: Column, table: dict[str, list[str]]) -> Column:
    """The first label, in the table's order, of which a keyword occurs in the lower-cased text; null without one."""
    low = F.lower(c)
    out = None
    for label, keys in table.items():
        hit = F.lit(False)
        for key in keys:
            hit = hit | F.contains(low, F.lit(key))
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return F.lit(None).cast("string") if out is None else out


def normalise(c: Column, mode: str = "punctuation") -> Column:
    """Lower case without punctuation ('punctuation'), or with runs of other than a-z and 0-9 as one blank ('ascii')."""
    if mode == "punctuation":
        return strip(F.regexp_replace(F.lower(c), NON_WORD, ""))
    if mode == "ascii":
        return strip(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    raise ValueError(mode)


def clean_answer(prediction: Column, reference: Column, guard_empty: bool = False) -> Column:
    """The normalised reference where the normalised prediction holds it, else the normalised prediction.

    An empty reference is held by every prediction, unless ``guard_empty``.
    """
    p, r = normalise(prediction), normalise(reference)
    held = F.contains(p, r) & (r != "") if guard_empty else F.contains(p, r)
    return F.when(held, r).otherwise(p)


def token_f1(prediction: Column, reference: Column) -> Column:
    """F1 of the multisets of tokens; 0 when either is empty.  Meant for short texts."""
    p, r = words(prediction), words(reference)
    common = F.aggregate(
        F.array_intersect(p, r),
        F.lit(0),
        lambda n, w: n + F.least(F.size(F.filter(p, lambda x: x == w)), F.size(F.filter(r, lambda x: x == w))),
    )
    total = F.size(p) + F.size(r)
    return F.when((F.size(p) == 0) | (F.size(r) == 0), F.lit(0.0)).otherwise(2.0 * common / total)


def exact_match(prediction: Column, reference: Column) -> Column:
    """1 when both agree up to case and white space at the ends, else 0; null counts as different."""
    return F.coalesce((strip(F.lower(prediction)) == strip(F.lower(reference))).cast("double"), F.lit(0.0))


def lenient_match(prediction: Column, reference: Column) -> Column:
    """Equal after ASCII normalisation, or a reference of at least two characters inside the prediction."""
    p, r = normalise(prediction, "ascii"), normalise(reference, "ascii")
    return F.coalesce((p == r) | ((F.length(r) >= 2) & F.contains(p, r)), F.lit(False))


def parse_candidate(raw: Column, candidates: Column) -> Column:
    """The candidate that a free answer names; null when none.

    The text after the last 'final answer:', then after the last 'answer:', decides.  An exact hit wins, otherwise the
    candidate whose last occurrence between word ends starts latest; of those at one place the greatest.
    """
    low = strip(F.lower(F.coalesce(raw, F.lit("None"))))
    for marker in ("final answer:", "answer:"):
        low = strip(F.substring_index(low, marker, -1))
    plain = strip(F.regexp_replace(low, "[^a-z0-9-]+", " "))
    same = F.filter(candidates, lambda c: F.lower(c) == plain)
    # a candidate's places: cut at the candidate where no letter or digit touches it
    padded = F.concat(F.lit(" "), low, F.lit(" "))

    def last_place(c: Column) -> Column:
        pattern = F.concat(F.lit("^(.*[^a-z0-9])(\\Q"), F.lower(c), F.lit("\\E)[^a-z0-9].*$"))
        # the greedy first group reaches to the last free-standing occurrence
        return F.length(F.call_function("regexp_extract", F.regexp_replace(padded, "\n", " "), pattern, F.lit(1)))

    hits = F.filter(F.transform(candidates, lambda c: F.struct(last_place(c).alias("at"), c.alias("c"))), lambda h: h["at"] > 0)
    return F.when(F.size(same) > 0, F.element_at(same, -1)).when(F.size(hits) > 0, F.array_max(hits)["c"])


def yes_no(prediction: Column, raw: Column, question_type: Column, binary: str = "modality_same_different") -> Column:
    """The prediction; for unparsed answers to yes-or-no questions 'same' for yes and 'different' for no."""
    plain = F.regexp_replace(F.lower(strip(raw)), "[^a-z]+", "")
    open_ = prediction.isNull() & (question_type == binary)
    return F.when(open_ & (plain == "yes"), F.lit("same")).when(open_ & (plain == "no"), F.lit("different")).otherwise(prediction)


def percent(c: Column) -> Column:
    """A share as a percentage with one digit after the point; '--' for null."""
    return F.when(c.isNull(), F.lit("--")).otherwise(F.format_string("%.1f", 100 * c))


def key_from_stem(stem: Column) -> Column:
    """The part of a file stem between the first '-' and the first '__'; null when either is missing."""
    head = F.substring_index(stem, "__", 1)
    return F.when((F.instr(stem, "__") > 0) & (F.instr(head, "-") > 0), F.regexp_extract(head, "(?s)^[^-]*-(.*)$", 1))


def reading_label(index: Column) -> Column:
    """'A' to 'Z' for 0 to 25, then 'p' and the number."""
    return F.when(index < 26, F.chr(index + 65)).otherwise(F.concat(F.lit("p"), index.cast("string")))


def panel_letter(panel_id: Column) -> Column:
    """The letters after the last underscore, upper-cased; the whole id when it does not end that way."""
    found = F.regexp_extract(panel_id, "_([A-Za-z]+)$", 1)
    return F.when(found != "", F.upper(found)).otherwise(panel_id)


def composite_key(*parts: Column, separator: str = "||") -> Column:
    """The parts joined by a separator, null parts as empty text."""
    return F.concat_ws(separator, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def seeded_order(key: Column, seed: int = 42) -> Column:
    """A reproducible random order: md5 of seed and key, the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def iso_stamp(moment: Column | None = None) -> Column:
    """ISO 8601 text of a timestamp (now, if none is given) to the second, in the session's time zone."""
    return F.date_format(moment if moment is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
