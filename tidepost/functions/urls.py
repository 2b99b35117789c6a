"""URL parts and canonical form as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepost.fixed import BOARD_HOSTS

_PARTS = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#.*)?$"


def _cleaned(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(_cleaned(url), _PARTS, group)


def authority(url: Column) -> Column:
    return F.lower(_part(url, 3))


def path(url: Column) -> Column:
    return _part(url, 4)


def query(url: Column) -> Column:
    return _part(url, 6)


def _decoded(text: Column) -> Column:
    # A '%' that starts no escape stands for itself.
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(text: Column) -> Column:
    return F.replace(
        F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
    )


def _key(pair: Column) -> Column:
    return _decoded(F.substring_index(pair, "=", 1))


def _value(pair: Column) -> Column:
    return _decoded(F.regexp_replace(pair, "(?s)^[^=]*=?", ""))


def query_pairs(url: Column) -> Column:
    """Array of (key, value), decoded, blank values kept, in order."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.struct(_key(p).alias("key"), _value(p).alias("value")))


#: Addresses that are their own canonical form: lower case up to the path, plain keys and values that track nobody.
_PAIR = r"(?![uU][tT][mM]_)[A-Za-z0-9_.~\-]+=[A-Za-z0-9_.~\-]*"
_CANONICAL = rf"^[a-z][a-z0-9+.\-]*://[a-z0-9.:\-]+(?:/[^?#\t\r\n]*)?(?:\?{_PAIR}(?:&{_PAIR})*)?\z"
#: A longer address is taken apart, as a pattern with very many pairs is not for the regex engine's stack.
_PLAIN_LENGTH = 1000


def canonical_url(url: Column) -> Column:
    """scheme and authority in lower case, tracking keys and fragment dropped."""
    plain = (F.length(url) <= _PLAIN_LENGTH) & url.rlike(_CANONICAL)
    return F.when(plain, url).otherwise(_rebuilt(url))


def _rebuilt(url: Column) -> Column:
    pieces = F.struct(
        F.lower(_part(url, 1)).alias("scheme"), authority(url).alias("host"), path(url).alias("path"),
        query_pairs(url).alias("pairs"),
    )
    return F.transform(F.array(pieces), _joined)[0]


def _joined(url: Column) -> Column:
    kept = F.filter(url["pairs"], lambda p: ~F.startswith(F.lower(p["key"]), F.lit("utm_")))
    text = F.array_join(
        F.transform(kept, lambda p: F.concat(_encoded(p["key"]), F.lit("="), _encoded(p["value"]))), "&"
    )
    no_root = (url["path"] != "") & ~F.startswith(url["path"], F.lit("/"))
    rooted = F.when(no_root, F.concat(F.lit("/"), url["path"])).otherwise(url["path"])
    return F.concat(
        F.when(url["scheme"] != "", F.concat(url["scheme"], F.lit(":"))).otherwise(""),
        F.when(url["host"] != "", F.concat(F.lit("//"), url["host"], rooted)).otherwise(url["path"]),
        F.regexp_replace(text, "(?s)^(.)", "?$1"),
    )


def path_words(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda p: p != "")


def board_for_host(url: Column) -> Column:
    """The adapter of a known board host, else null."""
    host = authority(url)
    out = F.lit(None).cast("string")
    for name, adapter in BOARD_HOSTS.items():
        out = F.when(host == name, adapter).otherwise(out)
    return out


def board_token(url: Column, adapter: Column) -> Column:
    """The board or site name an adapter asks for; null when the URL has none.

    Ashby takes the first segment of the trimmed path, Lever the first non-empty one,
    Greenhouse the first non-empty one on its own hosts and else the ``for`` key.
    """
    first_word = F.get(path_words(url), F.lit(0))
    ashby = F.nullif(F.substring_index(F.regexp_replace(path(url), "^/+|/+$", ""), "/", 1), F.lit(""))
    asked = F.get(
        F.filter(query_pairs(url), lambda p: (p["key"] == "for") & (p["value"] != "")), F.lit(0)
    )["value"]
    on_host = board_for_host(url) == "greenhouse"
    greenhouse = F.when(on_host & first_word.isNotNull(), first_word).otherwise(asked)
    return (
        F.when(adapter == "ashby", ashby)
        .when(adapter == "lever", first_word)
        .when(adapter == "greenhouse", greenhouse)
    )
