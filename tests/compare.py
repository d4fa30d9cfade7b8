"""Order-free comparison of a Spark result with a DuckDB result."""

import math


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    return round(float(v), 6) if isinstance(v, (int, float)) else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(([value(r[k]) for k in order] for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def same(df, relation):
    names = [d[0] for d in relation.description]
    assert sorted(df.columns) == sorted(names)
    a, b = rows_of(df.columns, df.collect()), rows_of(names, relation.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 1e-6 + 1e-9 * abs(p)) for p, q in zip(x, y)), (x, y)
