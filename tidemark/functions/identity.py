"""Event identity: 24 hexadecimal digits of a SHA-256 over the event's fields.

The hashed text is seq:entity:timestamp:type:value:attributes, with the value in its printed
form and the attributes as compact JSON with sorted keys (our own canonical form).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys and no spaces, by way of VARIANT."""
    return F.to_json(F.try_parse_json(text))


def event_id(sequence: Column, entity: Column, timestamp: Column, type_: Column, value: Column, attributes: Column) -> Column:
    parts = [sequence.cast("string"), entity, timestamp.cast("string"), type_, F.coalesce(value, F.lit("None")), attributes]
    return F.substring(F.sha2(F.concat_ws(":", *parts).cast("binary"), 256), 1, 24)
