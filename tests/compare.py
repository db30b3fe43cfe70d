"""Comparing rows of two engines."""

def rows(df, columns=None):
    """Rows as sorted tuples of text, doubles to nine digits, so that both engines' values compare."""
    import pandas as pd

    columns = columns or sorted(df.columns)

    def plain(v):
        if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)):
            return "NULL"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False))
