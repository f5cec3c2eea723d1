"""Stable identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shape of a canonical UUID.
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def turn_key(session: Column, text: Column) -> Column:
    """The same session and text always give the same key, so reloads add nothing."""
    digest = F.sha2(F.concat(session, F.lit(":"), text), 256)
    # Places of the digest in the layout of a stored key.
    spans = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, n) for start, n in spans])


def valid_uuid(c: Column) -> Column:
    """A canonical UUID, or NULL."""
    return F.when(c.rlike(UUID), c)


def payload_hash(*columns: Column) -> Column:
    """A digest in which NULL and the empty text differ."""
    return F.sha2(F.to_json(F.array(*[c.cast("string") for c in columns]), {"ignoreNullFields": "false"}), 256)
