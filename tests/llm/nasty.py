"""Rows that no operator may stumble over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep boolean, language string, run bigint, _row string, t string, shard int"
WORDS = "the and of that with from this have were been they will would there their which about other after first".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice(WORDS)[: r.randint(2, 5)] for _ in range(2)) + ("." if i % 12 == 11 else "") for i in range(n))


def documents(spark: SparkSession) -> DataFrame:
    long = "\n".join(prose(s, 400) for s in range(1000, 1150))
    rows = [
        (1, prose(1, 120), "en"),
        (2, prose(1, 120), "en"),  # an exact copy
        (3, prose(1, 118) + " quite different end", "en"),  # a near copy
        (4, None, "en"),
        (5, "", None),
        (6, "x", "en"),
        (7, long, "en"),
        (7, long, "en"),  # a repeated row
        (8, "éè üß " * 50, "fr"),
        (9, " \n\t ", "fr"),
        (None, prose(5, 60), None),
        (None, None, None),
        (10, prose(10, 90) + "\nLicensed under the Apache License, Version 2.0.", "fr"),
        (10, prose(11, 90), "fr"),  # the same id with another text
    ]
    return spark.createDataFrame([(i, t, lang, None, None if t is None else len(t), None, "zz", 3, "r", "t", 5) for i, t, lang in rows], SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
