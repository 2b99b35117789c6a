"""JobPosting objects inside the JSON-LD scripts of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepost.functions.text import filled

_SCRIPT_OR_COMMENT = r"(?is)(<script\b[^>]*>.*?</script\s*>)|<!--.*?-->"
_LD_SCRIPT = (
    r"(?s)<(?i:script)\b(?=[^>]*\s(?i:type)\s*=\s*"
    r"(?:\"application/ld\+json\"|'application/ld\+json'|application/ld\+json(?=[\s>])))"
    r"[^>]*>(.*?)</(?i:script)\s*>"
)


def ld_scripts(page: Column) -> Column:
    """Bodies of the JSON-LD scripts of a page, comments left out."""
    visible = F.regexp_replace(page, _SCRIPT_OR_COMMENT, "$1")
    return F.regexp_extract_all(visible, F.lit(_LD_SCRIPT), F.lit(1))


def scalar_text(value: Column) -> Column:
    """Text of a scalar; objects and lists as JSON."""
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))


def first_text(value: Column) -> Column:
    """A scalar, or the first entry of a list, as text."""
    entries = F.try_variant_get(value, "$", "array<variant>")
    return F.when(entries.isNotNull(), scalar_text(F.get(entries, F.lit(0)))).otherwise(
        filled(scalar_text(value))
    )


def place(value: Column) -> Column:
    """The first address with a town, region or country, its parts joined by commas."""
    entries = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value))
    parts = ("addressLocality", "addressRegion", "addressCountry")

    def joined(entry: Column) -> Column:
        return F.concat_ws(
            ", ",
            *[filled(scalar_text(F.try_variant_get(entry, f"$.address.{p}", "variant"))) for p in parts],
        )

    return F.get(F.filter(F.transform(entries, joined), lambda text: text != ""), F.lit(0))


def _is_posting(node: Column) -> Column:
    kind = F.try_variant_get(node, '$["@type"]', "variant")
    one = F.try_variant_get(kind, "$", "string") == "JobPosting"
    many = F.array_contains(F.try_variant_get(kind, "$", "array<string>"), "JobPosting")
    return F.coalesce(one, F.lit(False)) | F.coalesce(many, F.lit(False))


_NODE = "struct<path:array<int>,value:variant>"


def _children(node: Column) -> Column:
    """What a node holds, scalars too: they hold nothing, and asking their type would read the whole node again."""
    fields = F.map_entries(F.try_variant_get(node["value"], "$", "map<string,variant>"))
    graph_first = F.concat(
        F.filter(fields, lambda f: f["key"] == "@graph"),
        F.filter(fields, lambda f: f["key"] != "@graph"),
    )
    values = F.coalesce(
        F.transform(graph_first, lambda f: f["value"]),
        F.try_variant_get(node["value"], "$", "array<variant>"),
    )
    return F.coalesce(
        F.transform(
            values,
            lambda v, i: F.struct(
                F.concat(node["path"], F.array(i)).alias("path"), v.alias("value")
            ),
        ),
        F.array().cast(f"array<{_NODE}>"),
    )


def may_name_posting(text: Column) -> Column:
    """False only for JSON that cannot hold the type's name, which stands there letter by letter unless escaped."""
    return text.contains("JobPosting") | text.contains("\\u")


def _depth(script: Column) -> Column:
    """How deep a JSON text nests: its brackets outside strings, counted up and down in one pass."""
    plain = F.regexp_replace(F.regexp_replace(script, r"(?s)\\.", ""), r'"[^"]*"?', "")
    brackets = F.split(F.regexp_replace(plain, r"[^\[\]{}]+", ""), "")

    def step(state: Column, bracket: Column) -> Column:
        now = state["now"] + F.when(bracket.isin("[", "{"), 1).when(bracket.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(brackets, zero, step, lambda state: state["most"])


def _nodes(scripts: Column) -> Column:
    return F.filter(
        F.transform(
            scripts,
            lambda s, i: F.struct(F.array(i).alias("path"), F.try_parse_json(s).alias("value")),
        ),
        lambda n: n["value"].isNotNull(),
    )


def _levels(page: Column, first_only: bool) -> Column:
    """The postings of a page, an array for each level of nesting.

    One native fold inside the row goes a level deeper per step, as many steps as the deepest
    script has levels; what is found stays where it is, only the list of levels grows.
    """
    scripts = F.filter(ld_scripts(page), may_name_posting)

    def postings(nodes: Column) -> Column:
        return F.filter(nodes, lambda n: _is_posting(n["value"]))

    def deeper(state: Column, _step: Column) -> Column:
        below = F.flatten(F.transform(state["level"], _children))
        if first_only:
            below = F.when(F.exists(state["found"], lambda level: F.size(level) > 0), F.array().cast(f"array<{_NODE}>")).otherwise(below)
        return F.struct(
            below.alias("level"), F.concat(state["found"], F.array(postings(below))).alias("found")
        )

    top = _nodes(scripts)
    steps = F.greatest(F.coalesce(F.array_max(F.transform(scripts, _depth)), F.lit(1)), F.lit(1))
    return F.aggregate(
        F.sequence(F.lit(1), steps),
        F.struct(top.alias("level"), F.array(postings(top)).alias("found")),
        deeper,
        lambda state: state["found"],
    )


def page_postings(page: Column) -> Column:
    """Every JobPosting object of a page as an array, outer before inner, @graph first, however deep."""
    in_order = F.array_sort(
        F.flatten(_levels(page, first_only=False)),
        lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0),
    )
    return F.transform(in_order, lambda n: n["value"])


def has_posting(page: Column) -> Column:
    """Whether a page has a JobPosting object; the search ends at the first level that has one."""
    return F.exists(_levels(page, first_only=True), lambda level: F.size(level) > 0)
