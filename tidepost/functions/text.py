"""Text normalisation as native column expressions."""

from __future__ import annotations

import html
import re
from functools import reduce
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidepost.fixed import CASE_FOLDS

# White space as Unicode sees it, and the four separators U+001C..1F on top.
SPACES = r"(?U)[\s\x1c-\x1f]+"


def squeeze(text: Column) -> Column:
    """every run of white space becomes one blank, ends trimmed, null becomes ''."""
    return F.coalesce(F.trim(F.regexp_replace(text, SPACES, " ")), F.lit(""))


def _case_fold(text: Column) -> Column:
    folded = reduce(
        lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])), CASE_FOLDS.items(), text
    )
    special = "[" + "".join(CASE_FOLDS) + "]"
    return F.lower(F.when(text.rlike(special), folded).otherwise(text))


def plain_name(text: Column) -> Column:
    """case-folded words of ASCII letters and digits, single blanks between."""
    folded = F.regexp_replace(_case_fold(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")
    return F.trim(folded)


def filled(text: Column) -> Column:
    """Null for an empty string, so that ``coalesce`` skips it."""
    return F.nullif(text, F.lit(""))


def strip_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def company_or_source(company: Column, source_name: Column) -> Column:
    """the trimmed company name, or the name of the source when it is blank."""
    return F.coalesce(filled(strip_spaces(company)), source_name)


def contains_pattern(text: Column, needle: str) -> Column:
    """Case-insensitive contains; ``%`` and ``_`` in the needle stay wildcards."""
    return text.ilike(f"%{needle}%")


# -- F3: HTML to text ---------------------------------------------------------------

# One left-to-right scan: bodies that are not text, comments, declarations, then tags.
_MARKUP = (
    r"(?is)<script\b[^>]*>.*?</script\s*>"
    r"|<style\b[^>]*>.*?</style\s*>"
    r"|<!--.*?-->"
    r"|<!doctype[^>]*>"
    r"|</?[a-z][^>]*>"
)
# Entities decoded natively; the one for '&' comes last, so that one pass
# never decodes its own output.
_SIMPLE_ENTITIES = {
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "#39": "'",
    "nbsp": "\u00a0",
    "copy": "\u00a9",
    "reg": "\u00ae",
    "middot": "\u00b7",
    "ndash": "\u2013",
    "mdash": "\u2014",
    "lsquo": "\u2018",
    "rsquo": "\u2019",
    "ldquo": "\u201c",
    "rdquo": "\u201d",
    "bull": "\u2022",
    "hellip": "\u2026",
    "amp": "&",
}
_OTHER_ENTITY = "&(?!(?:" + "|".join(_SIMPLE_ENTITIES) + ");)[#a-zA-Z]"
# References that end in a semicolon.
_CLOSED = "&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);"
_OTHER_CLOSED_ENTITY = "&(?!(?:" + "|".join(_SIMPLE_ENTITIES) + ");)" + _CLOSED[1:]
_SPECIAL_MARKUP = (
    r"(?is)<(?:template|rt|rp|textarea|title|iframe|noembed|noframes|xmp|plaintext)\b[^>]*>[^<]*<(?!/)"
    r"|<(?:template|rt|rp|plaintext)\b"
    r"|<!(?!--|doctype)"
    r"|<\?"
    r"|<!--(?:>|->)"
    r"|=\s*\"[^\"<>]*[<>][^\"]*\""
    r"|=\s*'[^'<>]*[<>][^']*'"
)


def _decode_simple(text: Column) -> Column:
    decoded = reduce(
        lambda acc, e: F.replace(acc, F.lit(f"&{e[0]};"), F.lit(e[1])), _SIMPLE_ENTITIES.items(), text
    )
    return F.when(text.contains("&"), decoded).otherwise(text)


class _TextNodes(HTMLParser):
    """Collects the visible text nodes of one document."""

    hidden = {"script", "style", "template", "rt", "rp"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.inside: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.hidden:
            self.inside.append(tag)

    def handle_endtag(self, tag):
        if tag in self.inside:
            del self.inside[self.inside.index(tag):]

    def handle_data(self, data):
        if not self.inside:
            self.parts.append(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.parts.append(data[6:])


def _parsed_text(value: str | None) -> str | None:
    if value is None:
        return None
    parser = _TextNodes()
    parser.feed(html.unescape(value))
    parser.close()
    return " ".join(parser.parts)


def _closed_decoded(value: str) -> str:
    """References with a semicolon decoded, all others left as they are."""

    def decoded(found: re.Match) -> str:
        name = found.group()[1:]
        return html.unescape(found.group()) if name[0] == "#" or name in html5 else found.group()

    return re.sub(_CLOSED, decoded, value)


def _closed_parsed_text(value: str | None) -> str | None:
    """As ``_parsed_text``, but a reference without semicolon is text."""
    if value is None:
        return None
    parser = _TextNodes()
    parser.feed(re.sub(f"&(?!{_CLOSED[1:]})", "&amp;", _closed_decoded(value)))
    parser.close()
    return " ".join(parser.parts)


@F.pandas_udf(StringType())
def _parse_html(values: pd.Series) -> pd.Series:
    return values.map(_parsed_text)


@F.pandas_udf(StringType())
def _parse_closed_html(values: pd.Series) -> pd.Series:
    return values.map(_closed_parsed_text)


def with_plain_text(df: DataFrame, source: str, target: str, bare_references: bool = True) -> DataFrame:
    """adds the visible text of a fragment or page, entities decoded twice; empty is null.

    Browsers also decode some references that lack their semicolon (``&amp`` for ``&``); without ``bare_references`` these
    are text.

    Most fragments stay in the native form. Only those with rare entities, raw ``<`` or odd
    markup travel to Python, the others pass as nulls. The steps are columns of their own, so
    that each is computed once.
    """
    c = F.col
    rows = df.withColumn("_html", filled(c(source)))
    rows = rows.withColumn("_decoded", _decode_simple(c("_html")))
    rows = rows.withColumn("_bare", F.regexp_replace("_decoded", _MARKUP, " "))
    other = _OTHER_ENTITY if bare_references else _OTHER_CLOSED_ENTITY
    hard = (
        c("_html").rlike(other)
        | c("_decoded").rlike(other)
        | c("_bare").contains("<")
        | c("_decoded").rlike(_SPECIAL_MARKUP)
    )
    rows = rows.withColumn("_hard", hard)
    parse = _parse_html if bare_references else _parse_closed_html
    rows = rows.withColumn("_parsed", parse(F.when(c("_hard"), c("_html"))))
    text = F.when(c("_hard"), c("_parsed")).otherwise(_decode_simple(c("_bare")))
    rows = rows.withColumn(target, F.when(c("_html").isNotNull(), squeeze(text)))
    return rows.drop("_html", "_decoded", "_bare", "_hard", "_parsed")
