"""Terms of documents and the glossary built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name parts and endings that mark a technical term.
MARKS = ("API", "SDK", "CLI", "GUI", "UI", "UX", "DB", "SQL", "HTTP", "HTTPS", "TCP", "UDP", "IP", "DNS", "CSS", "HTML", "XML", "JSON")
ROLES = ("Service", "Controller", "Manager", "Handler", "Factory", "Builder", "Provider", "Repository")
ENDINGS = ("tion", "ment", "ness", "ity")
_W = r"[\p{L}\p{N}_]"
#: A whole word that is a term: an acronym, camel case, or (in any case) one with such a part or ending.
TERM = (
    rf"^(?:[A-Z]{{2,6}}|[A-Z][a-z]+(?:[A-Z][a-z]+)+|(?i:{_W}+(?:{'|'.join(MARKS)})|(?:{'|'.join(MARKS)}){_W}+|{_W}+(?:{'|'.join(ROLES)})|{_W}+(?:{'|'.join(ENDINGS)})))$"
)
WORD = f"{_W}+"


def technical_terms(text: Column, characters: int | None = None, most: int | None = None) -> Column:
    """Distinct terms among a text's words, as spelled, in order.

    ``characters`` looks at so many of the first characters only, ``most`` keeps so many of the first terms; both are
    off unless asked for.
    """
    words = F.regexp_extract_all(text if characters is None else F.left(text, F.lit(characters)), F.lit(WORD), 0)
    found = F.array_sort(F.filter(F.array_distinct(words), lambda w: w.rlike(TERM)))
    return found if most is None else F.slice(found, 1, most)


def first_spelling(terms: DataFrame, term: str, order: str, *keys: str) -> DataFrame:
    """One row for each lower-cased term of the keys, with its first spelling."""
    return terms.groupBy(*keys, F.lower(term).alias("key")).agg(F.min_by(term, F.struct(order, term)).alias(term))


def upsert(rows: DataFrame, scope: str, term: str, definition: str, document: str) -> DataFrame:
    """Glossary of each scope: documents seen, the longest definition (the first of equals), the first document."""
    longest = F.min_by(definition, F.struct(-F.length(definition), document))
    return rows.groupBy(scope, term).agg(F.count_distinct(document).alias("frequency"), longest.alias("definition"), F.min(document).alias("source_document"))


# Fixed value: the heading of a glossary's text block.
HEADING = "## Domain-Specific Terminology (Use these definitions for accuracy)"


def prompt(terms: Column) -> Column:
    """A text block from an ordered array of (term, category, definition); nothing without terms."""
    line = lambda t: F.concat(F.lit("- **"), t["term"], F.lit("**"), F.when(t["category"].isNotNull(), F.concat(F.lit(" ["), t["category"], F.lit("]"))).otherwise(""), F.lit(": "), t["definition"])
    head = F.array(F.lit(HEADING))
    return F.when(F.size(terms) > 0, F.array_join(F.concat(head, F.transform(terms, line)), "\n")).otherwise("")
