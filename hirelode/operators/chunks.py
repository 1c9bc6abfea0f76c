"""Chunking of profile texts: units found by ever finer splitters, cut into chunks by running sizes."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# From coarse to fine: lines, sentences, words.  Words are joined again as far as they fit.
SPLITTERS = [re.compile(r"\n"), re.compile(r"(?<=[.!?])\s+"), re.compile(r"\s+")]


def _cuts(size: np.ndarray, room: int, overlap: int = 0) -> list[tuple[int, int]]:
    """Ranges of items that fill ``room``; each range reaches back over at most ``overlap`` of the one before.

    Ends are found in the running sizes; an item larger than the room is a range of its own.
    """
    upto = np.concatenate([[0], np.cumsum(size)])
    ranges, begin, fresh = [], 0, 0
    while fresh < len(size):
        end = max(fresh + 1, int(np.searchsorted(upto, upto[begin] + room, side="right")) - 1)
        ranges.append((begin, end))
        begin, fresh = max(begin, int(np.searchsorted(upto, upto[end] - overlap, side="left"))), end
    return ranges


def _units(text: str, size: int, level: int = 0) -> list[str]:
    """The parts of a text that fit ``size``, by the coarsest splitter that makes them fit."""
    parts = [p for p in (x.strip() for x in SPLITTERS[level].split(text)) if p]
    if level + 1 < len(SPLITTERS):
        return [u for p in parts for u in ([p] if len(p) <= size else _units(p, size, level + 1))]
    if not parts:
        return []
    # a blank counts with every word of the first run, and between the words of later ones
    width = np.array([len(p) + 1 for p in parts])
    first = _cuts(width, size)[0][1]
    return [" ".join(parts[:first])] + [" ".join(parts[first + a:first + b]) for a, b in _cuts(width[first:], size + 1)]


def chunk_text(text: str | None, size: int = 600, overlap: int = 100) -> list[str]:
    """Chunks of up to ``size`` letters; a chunk starts with the last units of the one before, up to ``overlap``."""
    units = _units(text or "", size)
    return [" ".join(units[a:b]) for a, b in _cuts(np.array([len(u) + 1 for u in units], dtype=int), size, overlap)]


def chunk(df: DataFrame, key: str, text: str, size: int = 600, overlap: int = 100) -> DataFrame:
    """V1: (key, position, chunk_id, content) of every text, in order."""

    @F.pandas_udf("array<string>")
    def pieces(col: pd.Series) -> pd.Series:
        return col.map(lambda t: chunk_text(t, size, overlap))

    return df.select(key, F.posexplode(pieces(F.col(text))).alias("position", "content")).withColumn(
        "chunk_id", F.concat(F.lit("chunk_"), F.col("position").cast("string")))


def register_sql(spark) -> None:
    """chunk_text(text, size, overlap) as a table function, for SQL."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="position int, content string")
    class ChunkText:
        def eval(self, text: str, size: int, overlap: int):
            for i, content in enumerate(chunk_text(text, size, overlap)):
                yield i, content

    spark.udtf.register("chunk_text", ChunkText)
