"""secrets out of error texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepost.fixed import SECRET_KEYS

MASK = "[redacted]"
# Headers whose whole value is secret; it ends with the line.
SECRET_HEADERS = ("authorization", "cookie")


def _any_case(words: tuple[str, ...], before: str, secret: str) -> str:
    """A pattern for one of ``words`` and what leads up to the secret (kept), then the secret."""
    return rf"(?iU)(?<lead>\b(?:{'|'.join(words)}){before}){secret}"


# What is kept comes as group 1, what follows it is masked.
RULES = (
    (_any_case(SECRET_KEYS, "=", r"[^'\"&\s]+"), ""),
    (_any_case(SECRET_HEADERS, r":\s*", r"[^\s][^\n]*"), ""),
    # User name and password of an address.
    (r"(?iU)(?<lead>\bhttps?://|https?://)[^@/\s]+@", "@"),
)


def redacted(text: Column) -> Column:
    for pattern, after in RULES:
        text = F.regexp_replace(text, pattern, f"$1{MASK}{after}")
    return text


def stored_error(text: Column) -> Column:
    """The redacted text as a run keeps it: all of it, however long."""
    return redacted(text)
