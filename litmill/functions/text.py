"""Text and identifier normalisation as built-in column expressions (stay in whole-stage codegen).

The five text rules differ on purpose and are not merged.  Each has a built-in
form (lower case plus the sharp-s fold) and, through ``litmill.functions.exact``,
an Arrow form with full compatibility normalisation and case folding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space and word characters the rules speak of.
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
NON_WORD_OR_SPACE = r"[^\p{L}\p{N}_]+"
LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, even if the branches of body use it often."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def fold(c: Column) -> Column:
    """Case fold for the built-in path."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def match_text(c: Column) -> Column:
    """Folded words separated by single blanks; may be empty."""
    return F.trim(F.regexp_replace(fold(c), NON_WORD_OR_SPACE, " "))


def title_text(c: Column) -> Column:
    """Normalised title; null stands for the error of an empty one."""
    return null_if_empty(match_text(c))


def identity_text(c: Column) -> Column:
    return null_if_empty(match_text(c))


def term_text(c: Column) -> Column:
    """Vocabulary term: folded and collapsed, punctuation kept."""
    return collapse(fold(c))


def list_key(c: Column) -> Column:
    """Key for removing repeats in a list of texts."""
    return fold(collapse(c))


def single_line(c: Column) -> Column:
    return null_if_empty(collapse(c))


def multi_line(c: Column) -> Column:
    """Each line collapsed, blank lines dropped, line structure kept."""
    lines = F.filter(F.transform(F.split(c, LINE_BREAK), collapse), lambda x: x != "")
    return null_if_empty(F.array_join(lines, "\n"))


def first_of_each(values: Column, clean, key) -> Column:
    """Cleaned list items, the first of each key, blank keys left out; order kept.

    Keys are worked out once per item; only they are compared afterwards.
    """
    kind = "array<struct<k:string,v:string>>"
    items = F.transform(values, lambda x: F.struct(key(x).alias("k"), clean(x).alias("v")))

    def add(kept: Column, x: Column) -> Column:
        skip = (x["k"] == "") | x["k"].isNull() | F.exists(kept, lambda y: y["k"] == x["k"])
        return F.when(skip, kept).otherwise(F.concat(kept, F.array(x))).cast(kind)

    kept = F.aggregate(items, F.array().cast(kind), add)
    return F.transform(kept, lambda x: x["v"])


def doi(c: Column) -> Column:
    s = collapse(c)
    s = F.regexp_replace(s, r"^(?i)https?://(?:dx\.)?doi\.org/", "")
    s = F.regexp_replace(s, r"^(?i)doi\s*:\s*", "")
    s = fold(F.trim(s))
    return F.when(s.startswith("10.") & s.contains("/"), s)


def pmid(c: Column) -> Column:
    s = collapse(c)
    return F.when(s.rlike("^[0-9]+$"), s)


def pmcid(c: Column, strict: bool = False) -> Column:
    """PMC number; ``strict`` raises where the lenient form gives null."""
    s = F.upper(collapse(c))
    s = F.when(s.rlike("^[0-9]+$"), F.concat(F.lit("PMC"), s)).otherwise(s)
    good = s.rlike("^PMC[0-9]+$")
    if strict:
        return F.when(good, s).otherwise(
            F.raise_error(F.concat(F.lit("not a PMC number: "), F.coalesce(c, F.lit("null"))))
        )
    return F.when(good, s)


def http_url(c: Column, need_host: bool = False) -> Column:
    s = single_line(c)
    pattern = r"^(?i)https?://[^/?#\s]+" if need_host else r"^(?i)https?://"
    return F.when(s.rlike(pattern), s)


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor blank."""
    return F.coalesce(*[null_if_empty(strip(c.cast("string"))) for c in cols])


def article_key(*cols: Column, strict: bool = False) -> Column:
    """The article's id from the first filled id column; ``strict`` raises if all are blank."""
    key = first_filled(*cols)
    return F.coalesce(key, F.raise_error(F.lit("record has no article id"))) if strict else key


def first_author(authors_text: Column) -> Column:
    """Name before the first comma of an author string."""
    return single_line(F.split(authors_text, ",")[0])


def person_name(collective: Column, given: Column, family: Column, initials: Column) -> Column:
    """Collective name, else given and family name, else initials."""
    full = F.concat_ws(" ", single_line(given), single_line(family))
    return F.coalesce(single_line(collective), null_if_empty(full), single_line(initials))


def embedding_text(title: Column, keywords: Column, abstract: Column, limit: int | None = None) -> Column:
    """The text that is embedded: title, keywords and abstract blocks, absent blocks left out.

    The abstract is whole unless the model at hand sets a ``limit`` of characters.
    """
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    body = strip(F.coalesce(abstract, F.lit("")))
    body = body if limit is None else F.substring(body, 1, limit)
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("Title: "), strip(title)),
        F.when(F.size(keywords) > 0, F.concat(F.lit("Keywords: "), F.array_join(keywords, ", "))),
        F.when(body != "", F.concat(F.lit("Abstract: "), body)),
    )


def safe_file_name(stem: Column, fmt: Column) -> Column:
    """File name with unsafe characters replaced and an extension by format."""
    extension = F.coalesce(
        F.when(fmt == "pdf", ".pdf").when(fmt == "epub", ".epub").when(fmt == "html", ".html")
        .when(fmt == "xml", ".xml").when(fmt == "text", ".txt"),
        F.lit(".bin"),
    )
    return F.concat(F.regexp_replace(stem, r"[^A-Za-z0-9._-]+", "_"), extension)
