"""Results of a query and of its SQL, made alike."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def shown(x):
    """A cell as text: nulls alike, and whole numbers alike in any type."""
    if pd.api.types.is_scalar(x) and pd.isna(x):
        return "null"
    return str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)


def plain(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(shown, row)) for row in frame[columns].itertuples(index=False))
