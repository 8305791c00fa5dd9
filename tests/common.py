"""Shared by the tests of the core."""


def rows(df, *cols):
    """Rows as sorted tuples, for comparison."""
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)
