"""Label functions: normal forms and trigrams."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_NOT_WORD = re.compile(r"[\W_]+")


def normal_form(label: str) -> str:
    """Compatibility decomposition, marks dropped, case folded, punctuation to single blanks."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", label) if not unicodedata.combining(c))
    return _NOT_WORD.sub(" ", plain.casefold()).strip()


@F.pandas_udf(StringType())
def _normal_form_batch(labels: pd.Series) -> pd.Series:
    return labels.map(normal_form, na_action="ignore")


def normalized(label: Column) -> Column:
    """The normal form: built-ins for ASCII labels, Arrow batches (decomposition has no built-in) for others."""
    ascii_form = F.trim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", " "))
    return F.when(F.octet_length(label) == F.length(label), ascii_form).otherwise(_normal_form_batch(F.when(F.octet_length(label) != F.length(label), label)))


def trigrams(label: Column) -> Column:
    """Distinct trigrams of a label padded with two blanks before and one behind."""
    padded = F.concat(F.lit("  "), label, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))
