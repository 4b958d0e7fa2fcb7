"""Comparison of results of both engines."""

SF = "/root/testdata/sf0.001"


def plain(value):
    """A value in a form that both engines' results share."""
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "~" if value != value else f"{value:.8g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return str(value)


def same_rows(df, relation) -> None:
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    order = [relation.columns.index(n) for n in names]
    ours = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    theirs = sorted(tuple(plain(r[k]) for k in order) for r in relation.fetchall())
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert a == b or all(x == y or abs(float(x) - float(y)) <= 1e-6 * max(1, abs(float(y))) for x, y in zip(a, b, strict=True) if x != y)
