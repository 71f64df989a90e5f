def plain(value):
    return repr(round(value + 0.0, 9)) if isinstance(value, float) else str(value)


def assert_same(df, con, sql: str) -> None:
    """Equal rows, whatever their order, of a DataFrame and a DuckDB query."""
    rows, names = [tuple(r) for r in df.collect()], df.columns
    result = con.execute(sql)
    other = [c[0] for c in result.description]
    assert sorted(names) == sorted(other)
    left, right = [names.index(c) for c in sorted(names)], [other.index(c) for c in sorted(other)]
    a = sorted(tuple(plain(r[i]) for i in left) for r in rows)
    b = sorted(tuple(plain(r[i]) for i in right) for r in result.fetchall())
    assert a == b
