"""DataFrame -> DataFrame transforms. Lineage columns ``_file`` (source key) and
``_row`` (position inside the source) carry row order where an operator needs it."""

LINEAGE = ("_file", "_row", "_col")


def data_columns(df):
    return [c for c in df.columns if c not in LINEAGE]
