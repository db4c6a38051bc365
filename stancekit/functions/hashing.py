"""Portable seeded hash: every engine picks the same rows.

h(seed, key) = first 8 hex digits of md5("<seed>:<key>") read as an integer,
u(seed, key) = h / 2**32, uniform on [0, 1).
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def portable_hash(seed, key) -> Column:
    """32-bit unsigned hash as BIGINT."""
    seed_c = F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string")
    digest = F.md5(F.concat(seed_c, F.lit(":"), _c(key).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def unit_hash(seed, key) -> Column:
    """Uniform double in [0, 1) from the portable hash."""
    return portable_hash(seed, key) / F.lit(TWO_32)


def sentence_key(speech_id="speech_id", sent_idx="sent_idx") -> Column:
    """Text key of a sentence row: '<speech_id>-<sent_idx>'."""
    return F.concat(_c(speech_id).cast("string"), F.lit("-"), _c(sent_idx).cast("string"))
