"""The tables of a folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Strings, quoted names and comments, in which no table is named.
_QUOTED = re.compile(r"""('(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*)""")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Runs SQL over the tables that it names.

    Names are bound to the folder as arguments of the statement, so queries over several folders don't share views.
    """
    pieces = _QUOTED.split(text)  # every second one is quoted
    used = [n for n in NAMES if any(re.search(rf"\b{n}\b(?!\.)", p) for p in pieces[::2])]
    if not used:
        return spark.sql(text)
    pieces = [p.replace("{", "{{").replace("}", "}}") for p in pieces]
    pieces[::2] = [re.sub(r"\b(" + "|".join(used) + r")\b(?!\.)", r"{\1}", p) for p in pieces[::2]]
    bound = "".join(pieces)
    return spark.sql(bound, **{n: table(spark, sf_dir, n) for n in used})
