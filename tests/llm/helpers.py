"""Rows that every operator has to bear: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import duckdb
import pandas as pd

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word and more words\n" * 20_000 + "x" * 50_000

EDGES = [
    (1, "The quick brown fox jumps over the lazy dog and runs away.\nA second line that is here for the sake of it, too.", "en", "a", 100),
    (2, "The quick brown fox jumps over the lazy dog and runs away.\nAnother line that nobody else has in all of these rows.", "en", "a", 100),
    (3, None, None, None, None),
    (4, "", "en", "", 0),
    (5, " \n\t ", "de", "b", 4),
    (6, LONG, "en", "c", len(LONG)),
    (7, "same", "en", "b", 4),
    (8, "same", "en", "b", 4),
    (8, "same", "en", "b", 4),
    (9, "naïve café — 漢字 😀 don't   stop", "fr", None, 20),
    (None, "no id here, but a text of more than eight words in it", "en", "a", None),
    (None, None, None, None, None),
]


def edges(spark):
    return spark.createDataFrame(EDGES, DOCUMENTS)


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def clashing(df):
    """Columns of the names that operators use themselves."""
    for name in ("score", "size", "taken", "leaves", "removed", "token_ids", "decoded", "rank", "Position", "fp"):
        df = df.selectExpr("*", f"'kept' AS `{name}`")
    return df


def duck(sql: str, **tables) -> list[tuple]:
    connection = duckdb.connect()
    for name, df in tables.items():
        frame = df.toPandas() if not isinstance(df, pd.DataFrame) else df
        for column in ("doc_id", "page_id", "n_chars"):
            if column in frame:
                frame[column] = frame[column].astype("Int64")
        connection.register(name, frame)
    return connection.sql(sql).fetchall(), connection.sql(sql).columns


def same_as_sql(found, sql: str, **tables) -> None:
    rows, columns = duck(sql, **tables)
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    order = [found.columns.index(c) for c in columns]
    ours = sorted((tuple(r[k] for k in order) for r in found.collect()), key=key)
    assert ours == sorted(map(tuple, rows), key=key)
