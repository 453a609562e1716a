"""Name columns: evaluated once per distinct raw name, then joined back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N


def _parse(raw: pd.Series) -> pd.DataFrame:
    read = [N.read(r) for r in raw]
    rows = [(n.text, n.key, n.display, n.core, n.formal) if n else (None,) * 5 for n in read]
    return pd.DataFrame(rows, columns=["clean", "key", "display", "bare", "formal"])


def _bare(raw: pd.Series) -> pd.Series:
    return raw.map(N.strip_titles, na_action="ignore")


def bare_words(name: str) -> Column:
    """The words of a name without its titles."""
    return F.split(F.pandas_udf(_bare, "string", F.PandasUDFType.SCALAR)(name), r"(?U)\s+")


def parse_name(raw: str) -> Column:
    return F.pandas_udf(_parse, "clean string, key string, display string, bare string, formal boolean", F.PandasUDFType.SCALAR)(raw)


def with_names(df: DataFrame, raw: str) -> DataFrame:
    """Adds the struct column `name_parts` (clean, key, display, bare, formal); all null where the text is no name."""
    distinct = df.select(raw).where(F.col(raw).isNotNull()).distinct().withColumn("name_parts", parse_name(raw))
    return df.join(distinct, raw, "left")


def pick_display(forms: DataFrame, key: str, form: str, n: str) -> DataFrame:
    """(key, display): formal titles win, then the count, then the shortest, then the first form."""
    totals = forms.groupBy(key, form).agg(F.sum(n).alias("n"))
    rated = with_names(totals, form).withColumn("formal", F.coalesce(F.col("name_parts.formal"), F.lit(False)))
    best = rated.groupBy(key).agg(F.min(F.struct((~F.col("formal")).alias("a"), (-F.col("n")).alias("b"), F.length(form).alias("c"), F.col(form).alias("form"))).alias("best"))
    return best.select(key, F.col("best.form").alias("display"))


def refresh_display(stored: DataFrame, picked: DataFrame, key: str, name: str = "name") -> DataFrame:
    """(key, name) of a dimension after new forms: a stored name gives way only to a form with a formal title, where it has none."""
    rows = stored.join(picked, key, "left")
    formal = lambda c: F.coalesce(F.pandas_udf(_formal, "boolean", F.PandasUDFType.SCALAR)(c), F.lit(False))
    return rows.select(key, F.when(F.col(name).isNull() | (~formal(name) & formal("display")), F.coalesce("display", name)).otherwise(F.col(name)).alias(name))


def _formal(raw: pd.Series) -> pd.Series:
    return raw.map(N.has_formal_title, na_action="ignore").astype("boolean")


def _sorted_by(raw: pd.Series) -> pd.Series:
    return raw.map(N.sort_name, na_action="ignore")


def sort_name(name: str) -> Column:
    """The name without its titles, as lists are sorted by it."""
    return F.pandas_udf(_sorted_by, "string", F.PandasUDFType.SCALAR)(name)
