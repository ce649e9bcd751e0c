"""Normal forms that Spark SQL lacks, as Arrow-batched UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def normalize_name(names: pd.Series) -> pd.Series:
    """NFKC, case-folded, white space squeezed."""
    return names.map(lambda s: " ".join(unicodedata.normalize("NFKC", s).casefold().split()), na_action="ignore")


@pandas_udf(StringType())
def wikilink_key(targets: pd.Series) -> pd.Series:
    """Alias key of a link target: no ``#anchor``, NFKC, lower case, sharp s, final sigma and long s folded."""
    fold = str.maketrans({"ß": "ss", "ς": "σ", "ſ": "s"})
    return targets.map(
        lambda s: " ".join(unicodedata.normalize("NFKC", s.split("#", 1)[0]).lower().translate(fold).split()), na_action="ignore"
    )


@pandas_udf(StringType())
def study_key_text(lemmas: pd.Series) -> pd.Series:
    """NFC, stripped, lower case."""
    return lemmas.map(lambda s: unicodedata.normalize("NFC", s.strip()).lower(), na_action="ignore")


@pandas_udf(StringType())
def squeezed_name(names: pd.Series) -> pd.Series:
    """Like ``normalize_name``, but white space is squeezed before the case is folded; null stays null."""
    nfkc = names.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")
    return nfkc.str.split().str.join(" ").str.casefold()
