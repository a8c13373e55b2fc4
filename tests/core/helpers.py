"""Small event tables for the tests."""

import json

from tidemark.model import EVENTS

T = 1_788_098_000


def kind(v):
    if v is None:
        return "null", None, None
    if isinstance(v, bool):
        return "bool", float(v), str(v)
    if isinstance(v, int | float):
        return "number", float(v), str(v)
    return "string", None, v


def events(spark, rows, attributes=None):
    """Rows (entity, timestamp, type, value); ids e1, e2, ... and sequence numbers by position."""
    out = []
    for i, (entity, ts, type_, value) in enumerate(rows, 1):
        k, n, s = kind(value)
        a = json.dumps((attributes or {}).get(i, {}))
        out.append((f"e{i}", entity, ts, type_, k, n, s, a, i))
    return spark.createDataFrame(out, EVENTS)


#: One server over twelve minutes.
DEMO = [
    ("server-42", T + 60 * i, t, v)
    for i, (t, v) in enumerate(
        [
            ("cpu", 41.2), ("memory", 48.5), ("cpu", 40.8), ("memory", 49.1), ("cpu", 42.5), ("errors", 2), ("cpu", 39.9),
            ("deployment", "v2.8.1"), ("cpu", 61.4), ("latency", 84.0), ("errors", 17), ("cpu", 94.2), ("errors", 41),
        ]
    )
]
