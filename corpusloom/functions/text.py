"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_norm(text: Column | str) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def content_sha(text: Column | str) -> Column:
    return F.sha2(text, 256)


def is_heldout(sha: Column | str, modulo: int = 4) -> Column:
    """First 8 hex digits of the sha, as a number, divisible by modulo."""
    return F.conv(F.substring(sha, 1, 8), 16, 10).cast("bigint") % modulo == 0
