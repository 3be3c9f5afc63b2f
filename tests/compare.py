"""Results as comparable rows."""

from __future__ import annotations

import math
from collections import Counter


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v + 0.0:.6g}"
    if isinstance(v, int):
        return f"{float(v):.6g}" if abs(v) < 2**53 else str(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows(names, data) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def same(df, con, sql: str) -> None:
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    want_names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(want_names)
    want = rows(want_names, found.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
