"""The column functions under names that SQL can call, built from the same expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import fields as V
from . import skills as S
from . import text as T

# name: the function of its arguments (all texts), in order
FUNCTIONS: dict[str, tuple[Callable[..., Column], list[str]]] = {
    "normalize_url": (T.normalize_url, ["url"]), "clean_company": (T.clean_company, ["name"]), "clean_title": (T.clean_title, ["title"]),
    "clean_location": (T.clean_location, ["place"]), "posting_req_id": (T.req_id, ["stated", "url"]),
    "canonical_id": (T.canonical_id, ["company", "title", "place", "url"]), "min_experience_years": (V.min_experience_years, ["text"]),
    "classify_role": (S.classify_role, ["title", "description"]), "token_set_ratio": (T.token_set_ratio, ["a", "b"])}

_LITERAL = re.compile(r"'(?:[^'\\]|\\.|'')*'")
_OPERATOR = re.compile(r"(?<![\w`])(or|and|not|[=<>!+\-*/%&|^]+)(?=\()")


def sql_text(col: Column) -> str:
    """A column expression as SQL; operators become calls by their quoted names, literals stay as they are."""
    text, out, at = col._jc.node().sql(), [], 0
    for literal in _LITERAL.finditer(text):
        out += [_OPERATOR.sub(r"`\1`", text[at:literal.start()]), literal.group()]
        at = literal.end()
    return "".join(out) + _OPERATOR.sub(r"`\1`", text[at:])


def register_functions(spark: SparkSession) -> list[str]:
    """Make every function callable from SQL in this session; their names."""
    for name, (build, args) in FUNCTIONS.items():
        body = build(*[F.col(f"arg_{a}") for a in args])
        sample = spark.range(0).select(*[F.lit("").alias(f"arg_{a}") for a in args])
        kind = sample.select(body.alias("x")).schema["x"].dataType.simpleString()
        takes = ", ".join(f"arg_{a} STRING" for a in args)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {kind} RETURN {sql_text(body)}")
    return list(FUNCTIONS)
