"""Every core query runs at the smallest size; those with SQL agree with DuckDB."""

import glob
import math
import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

from plenum.operators import tokenize
from plenum.plans import registry


def _rows(df: pd.DataFrame):
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return ""
        if isinstance(v, float):
            return f"{v:.4f}"
        kind = type(v).__name__
        return str(v)[:10] if kind in ("date", "Timestamp", "datetime") else f"{float(v):.4f}" if kind.startswith(("int", "bool")) else str(v)

    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in glob.glob(small + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, small, name):
    got = registry.QUERIES[name](spark, small)
    floats = [c for c, t in got.dtypes if t in ("bigint", "int", "smallint", "double")]
    got = got.toPandas()
    assert len(got.columns)
    if name in registry.ORACLE:
        want = duck.execute(registry.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        for c in floats:
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
        assert _rows(got) == _rows(want)


def test_shares_are_whole(spark, small):
    """The pivoted shares of a day with words add up to one: no party is left out."""
    got = registry.QUERIES["agg25_all_shares"](spark, small).toPandas()
    assert len(got.columns) > 4 and "party_rest" in got.columns
    assert all(abs(x - 1) < 1e-4 for x in got.drop(columns="meeting_date").sum(axis=1))


def test_token_grams(spark, small):
    """Bag of words and n-grams of all texts against counting in Python: Thai is in, and runs of five."""
    terms = pd.read_parquet(small + "/terms.parquet")["term"].dropna().unique()
    cut = tokenize.Lexicon(dict.fromkeys(terms, 1000)).tokens
    docs = pd.read_parquet(small + "/documents.parquet").drop_duplicates("doc_id").dropna(subset=["text"])
    said = pd.read_parquet(small + "/speeches.parquet").drop_duplicates("id").dropna(subset=["text"])
    tokens = {i: cut(t) for i, t in zip(docs["doc_id"], docs["text"])}
    runs = lambda ts: [ts[i : i + n] for n in range(1, 6) for i in range(len(ts) - n + 1)]
    bag = Counter((i, t) for i, ts in tokens.items() for t in ts)
    assert {(r["doc_id"], r["term"]): r["n"] for r in registry.QUERIES["agg10_token_bag"](spark, small).collect()} == bag
    every = list(tokens.values()) + [cut(t) for t in said["text"]]
    want = Counter((len(g), " ".join(g)) for ts in every for g in runs(ts) if len(g) == 1 or len("".join(g)) <= 25)
    got = {(r["length"], r["gram"]): r["n"] for r in registry.QUERIES["agg20_token_ngrams"](spark, small).collect()}
    assert got == want and any(n == 5 and "ก" <= g[0] <= "๏" for n, g in got)


def test_phrases(spark, small):
    got = registry.QUERIES["min5_phrases"](spark, small).collect()
    assert len({r["word"] for r in got}) == len(got) > 0 and all(r["n"] >= 3 and len(r["word"]) <= 25 for r in got)


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
