"""Descriptions apart from their rows.

Many postings share one description, and it is far longer than the rest of a row.  Rows that
are grouped, joined or stored carry its mark (SHA-256) and its length instead; the different
texts are a table of their own and join back by the mark.  Where nobody reads the text, Spark
drops that join, because marks are unique.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import set_aside, shuffles_go_early

TEXTS = "__mark binary, __text string"      # a table of different texts
TEXT, MARK, LENGTH = "description", "description_mark", "description_length"


def mark_of(value) -> Column:
    """Mark of a text, or of any value by the text it casts to."""
    return F.unhex(F.sha2((F.col(value) if isinstance(value, str) else value).cast("string"), 256))


def texts_of(df: DataFrame) -> DataFrame:
    """Different descriptions of a frame by their mark: each task first folds its own, without a sort."""
    return _by_mark(_different(df))


def _different(df: DataFrame) -> DataFrame:
    different = df.select(F.col(TEXT).alias("__text")).where("__text IS NOT NULL").distinct()
    return different.select(mark_of(F.col("__text")).alias("__mark"), "__text")


def texts_aside(df: DataFrame) -> DataFrame:
    """texts_of, found and written once for all that read it: the shuffle that found them is gone before the next."""
    shuffles_go_early(df.sparkSession)
    return _by_mark(set_aside(_different(df), "texts"))


def _by_mark(texts: DataFrame) -> DataFrame:
    return texts.groupBy("__mark").agg(F.first("__text").alias("__text"))


def all_texts(*texts: DataFrame) -> DataFrame:
    return _by_mark(reduce(DataFrame.unionByName, texts))


def leave_texts(df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows with mark and length in place of the description, different descriptions)."""
    if TEXT not in df.columns:
        return df, None
    length = F.length(F.coalesce(TEXT, F.lit("")))
    return df.select(*[c for c in df.columns if c != TEXT], mark_of(TEXT).alias(MARK), length.alias(LENGTH)), texts_of(df)


def bring_texts(rows: DataFrame, texts: DataFrame | None, columns: list[str] | None = None, keep: bool = False) -> DataFrame:
    """Rows with their descriptions again, in place of mark and length or beside them (``keep``); ``columns`` come first, in that order."""
    if texts is None:
        return rows
    full = rows.join(texts, rows[MARK] == texts["__mark"], "left").withColumn(TEXT, F.col("__text")).drop("__text", "__mark")
    full = full if keep else full.drop(MARK, LENGTH)
    names = [c for c in columns or [] if c in full.columns]
    return full.select(*names, *[c for c in full.columns if c not in names])


def once_each(df: DataFrame, given: list[str], compute: Callable[[DataFrame], DataFrame], texts: DataFrame | None = None) -> DataFrame:
    """Adds the columns that ``compute`` makes of ``given``, worked out once for all rows with the same values.

    ``compute`` also sees ``__key``, unique among its rows, and passes it on.  With
    ``texts`` the rows have left their descriptions there.  Those that have not do so here:
    a description is shuffled once, not once for each title it stands with.
    """
    left, inside = texts is not None and TEXT in given, texts is None and TEXT in given and TEXT in df.columns
    own = [MARK if left and c == TEXT else c for c in given]
    nothing = F.lit(bytes(32))
    key = F.concat(*[F.coalesce(F.col(c) if c == MARK else mark_of(c), nothing) for c in own]).alias("__key")
    if inside:
        texts = texts_aside(df)
        values = df.select(*[mark_of(c).alias(MARK) if c == TEXT else F.col(c) for c in given]).distinct()
        own, left = [MARK if c == TEXT else c for c in given], True
    else:
        values = df.select(*own).distinct()
    if left:
        values = values.join(texts, values[MARK] == texts["__mark"], "left") \
            .select(F.concat(*[F.coalesce(F.col(c) if c == MARK else mark_of(c), nothing) for c in own]).alias("__key"),
                    *[F.col("__text").alias(TEXT) if c == TEXT else F.col(c) for c in given])
    else:
        values = values.select(key, *given)
    found = compute(values)
    new = [c for c in found.columns if c not in given and c != "__key"]
    kept = [c for c in df.columns if c not in new]
    return df.select(*kept, key).join(found.select("__key", *new), "__key", "left").select(*kept, *new)
