"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

Everything runs as DataFrame expressions. Patterns give base spans. Two models of adjacent characters are trained from
labelled samples: random strings of each common alphabet and the values that the patterns find, all alphabets with the
same weight, are random; words of documents without a find, also in capitals and joined to names, are ordinary
identifiers. Other tokens are secrets too if the log-likelihood ratio of the models says random.
"""

from __future__ import annotations

import json
import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepost.llm.frames import free_name, one_in, only, whole
from tidepost.session import written

# The patterns of the base, in the order of their kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
ASSIGN_CHARS = 12

#: Characters that the models know, as codes from 33 to 126.
FIRST, WIDTH = 33, 94
#: Characters that tokens are made of; unseen pairs share their prior.
LIKELY = 66

_LOWER, _UPPER, _DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
#: Alphabets of random strings; each counts in the model as this many pairs of adjacent characters.
ALPHABETS = (
    _DIGITS + "abcdef", _DIGITS + "ABCDEF", _LOWER, _UPPER, _LOWER + _DIGITS, _UPPER + _DIGITS,
    _LOWER + _UPPER, _LOWER + _UPPER + _DIGITS, _LOWER + _UPPER + _DIGITS + "+/", _LOWER + _UPPER + _DIGITS + "-_",
)
ALPHABET_PAIRS = 20_000.0
#: Share of ordinary words that stand in capitals, and of letters that a joint of a name follows.
CAPITALS, JOINTS = 0.2, 0.1


@dataclass(frozen=True)
class Models:
    """``length`` is the least length of a token that the models judge, ``per_char`` and ``total`` the log-likelihood ratios
    (in nats) that it must reach. Of held-out random strings of 12 to
    40 characters in seven alphabets and of UUIDs, at least 95 in 100 of each kind pass at sf0.01. ``sample`` bounds the documents whose words train the model of
    identifiers (about so many, chosen by a hash)."""

    length: int = ASSIGN_CHARS
    per_char: float = 0.4
    total: float = 5.0
    sample: int = 4000
    prior_random: float = 40.0
    prior_ordinary: float = 20.0

    @property
    def token(self) -> str:
        return rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{self.length},}}"


SPAN = "struct<kind:int,start:int,end:int,value:string>"


def spans(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """array of (kind, start, end, value): all matches, counted in code points; value is the group's text.

    The pieces between the matches and the matches themselves add up to the text, which gives the places.
    """
    matches, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.split(text, pattern, -1)
    zipped = F.arrays_zip(matches.alias("m"), values.alias("v"), F.slice(pieces, 1, F.size(matches)).alias("p"))
    none = F.array().cast(f"array<{SPAN}>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["p"])
        end = begin + F.length(x["m"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["v"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span.cast(SPAN))).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(zipped, start, step, lambda acc: acc["out"])).otherwise(none)


def base_spans(text: Column) -> Column:
    """The base spans by start, then kind."""
    assign = F.filter(spans(text, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= ASSIGN_CHARS)
    return F.array_sort(F.concat(assign, spans(text, ACCESS, 1), spans(text, HEX, 2)), _by_start)


def _by_start(a: Column, b: Column) -> Column:
    one, other = a["start"] * 4.0 + a["kind"], b["start"] * 4.0 + b["kind"]
    return F.when(one < other, -1).when(one > other, 1).otherwise(0)


def pairs(strings: DataFrame) -> DataFrame:
    """(pair, n): how often each pair of adjacent known characters occurs in ``strings`` (value, n times). At most WIDTH ** 2 rows."""
    long_ = strings.filter(F.length("value") > 1)
    at = long_.select("value", "n", F.explode(F.sequence(F.lit(1), F.length("value") - 1)).alias("i"))
    codes = at.select("n", F.ascii(F.expr("substr(value, i, 1)")).alias("a"), F.ascii(F.expr("substr(value, i + 1, 1)")).alias("b"))
    known = codes.filter(f"a between {FIRST} and {FIRST + WIDTH - 1} and b between {FIRST} and {FIRST + WIDTH - 1}")
    return known.groupBy(((F.col("a") - FIRST) * WIDTH + F.col("b") - FIRST).alias("pair")).agg(F.sum("n").alias("n"))


def pair(a: str, b: str) -> int:
    return (ord(a) - FIRST) * WIDTH + ord(b) - FIRST


def balanced(found: dict[int, int]) -> dict[int, float]:
    """Pairs of random strings: what is expected of each alphabet and of UUIDs, and the pairs found; all of one weight."""
    out = {k: n * ALPHABET_PAIRS / sum(found.values()) for k, n in found.items()}

    def add(a: str, b: str, n: float) -> None:
        out[pair(a, b)] = out.get(pair(a, b), 0) + n

    for chars in ALPHABETS:
        for a in chars:
            for b in chars:
                add(a, b, ALPHABET_PAIRS / len(chars) ** 2)
    for digits in ALPHABETS[:2]:  # a UUID has 35 pairs, 8 of them with a hyphen
        for a in digits:
            add(a, "-", ALPHABET_PAIRS * 4 / 35 / 16)
            add("-", a, ALPHABET_PAIRS * 4 / 35 / 16)
            for b in digits:
                add(a, b, ALPHABET_PAIRS * 27 / 35 / 256)
    return out


def varied(words: dict[int, int]) -> dict[int, float]:
    """Pairs of identifiers: those of the words, of words in capitals, and of words joined to names (by a character or by
    a capital letter)."""
    out: dict[int, float] = dict(words)
    ends = dict.fromkeys(_LOWER, 0)

    def add(a: str, b: str, n: float) -> None:
        out[pair(a, b)] = out.get(pair(a, b), 0) + n

    for a in _LOWER:
        for b in _LOWER:
            n = words.get(pair(a, b), 0)
            ends[a] += n
            add(a.upper(), b.upper(), n * CAPITALS)
            add(a.upper(), b, n * JOINTS)
    total = max(1, sum(ends.values()))
    for a, n in ends.items():
        for joint in "_-/":
            for one, share in ((a, 1.0), (a.upper(), CAPITALS)):
                add(one, joint, n * JOINTS * share / 3)
                add(joint, one, n * JOINTS * share / 3)
        for b, m in ends.items():
            add(a, b.upper(), n * JOINTS * m / total)
    return out


def log_ratio(random: dict[int, float], ordinary: dict[int, float], how: Models) -> list[float]:
    """For each pair the log of P(second | first) among random strings over that among identifiers."""

    def model(counts: dict[int, float], prior: float) -> list[float]:
        out = []
        for a in range(WIDTH):
            row = [counts.get(a * WIDTH + b, 0) for b in range(WIDTH)]
            out += [math.log((n + prior / LIKELY) / (sum(row) + prior)) for n in row]
        return out

    both = zip(model(random, how.prior_random), model(ordinary, how.prior_ordinary), strict=True)
    return [round(r - o, 6) for r, o in both]


def ratio(value: Column, table: Column) -> Column:
    """The log-likelihood ratio of a string."""
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c) - FIRST)
    known = F.filter(codes, lambda c: (c >= 0) & (c < WIDTH))
    both = F.zip_with(F.slice(known, 1, F.greatest(F.size(known) - 1, F.lit(0))), F.slice(known, 2, F.size(known)), lambda a, b: a * WIDTH + b)
    return F.aggregate(both, F.lit(0.0), lambda acc, p: acc + F.get(table, p))


def train(found: DataFrame, docs: DataFrame, rows: int, how: Models) -> list[float]:
    """The table of log-likelihood ratios, from ``found`` (base spans) and the words of a bounded sample of ``docs``."""
    values = found.select(F.explode("base").alias("s")).select(F.col("s.value").alias("value"))
    some = docs.filter(one_in(F.xxhash64("doc_id", F.lit(5)), rows, how.sample)).filter(F.size(base_spans(F.col("text"))) == 0)
    words = some.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/_=-]{6,}"), F.lit(0))).alias("value"))
    # A word that stands only once may be a random string itself.
    words = words.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    values = values.withColumn("n", F.lit(1))
    random, ordinary = ({r[0]: r[1] for r in pairs(x).collect()} for x in (values, words))  # at most WIDTH ** 2 rows each
    return log_ratio(balanced(random), varied(ordinary), how)


def scan(docs: DataFrame, how: Models | None = None, text: str = "text", spans_name: str = "secrets") -> DataFrame:
    """All columns of ``docs`` but ``text``, and ``secrets``: array of (kind, start, end, value) by start, then kind.

    Kinds are numbers into ``KINDS``; places count code points, ends are exclusive; value is the secret itself. Base spans
    may overlap one another; a token that overlaps a base span is not added again. A null text counts as empty and has
    none. Other columns, also of clashing names, are kept as they are; repeated rows stay repeated.
    """
    how = how or Models()
    base, tokens, key, body = (free_name(docs, n) for n in ("secret_base", "secret_tokens", "secret_key", "secret_text"))
    rest = [c for c in docs.columns if c != text]
    read = docs.select(*[docs[f"`{c}`"] for c in rest], whole(docs[f"`{text}`"]).alias(body))
    found = written(
        read.select(*[F.col(f"`{c}`") for c in rest], base_spans(F.col(body)).alias(base), spans(F.col(body), how.token, 3).alias(tokens)),
        "secrets",
    )
    del key
    plain = only(docs, text=text).select(F.xxhash64("text").alias("doc_id"), whole(F.col("text")).alias("text"))
    table = train(found.select(F.col(base).alias("base")), plain, found.count(), how)
    # A table of fixed size, folded into one literal by the optimiser.
    learned = F.from_json(F.lit(json.dumps(table)), "array<double>")
    apart = F.filter(
        F.col(tokens), lambda t: ~F.exists(F.col(base), lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"]))
    )
    score = lambda t: ratio(t["value"], learned)
    added = F.filter(apart, lambda t: (score(t) >= how.total) & (score(t) >= how.per_char * F.length(t["value"])))
    return found.select(*[F.col(f"`{c}`") for c in rest], F.array_sort(F.concat(base, added), _by_start).alias(free_name(docs, spans_name)))


def digest(scanned: DataFrame, secrets: str = "secrets") -> DataFrame:
    """doc_id, counts of the base kinds, SHA-256 of the base spans, and all spans as text."""
    base = F.filter(F.col(secrets), lambda s: s["kind"] < 3)
    kind = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter(F.col(secrets), lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(i).alias(f"n_{name}") for i, name in enumerate(KINDS[:3])],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col(secrets)).alias("spans"),
    )
