"""Functions that neither Spark has nor plans.dialect can put in its words."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def strip_accents(texts: pd.Series) -> pd.Series:
    """Texts without the marks of their letters, whatever the letter; nulls stay."""
    return texts.map(lambda t: unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))), na_action="ignore")


def register(spark: SparkSession) -> None:
    spark.udf.register("strip_accents", F.pandas_udf(strip_accents, "string"))
