"""Problem 2: how distinctive a term is for a record.

Hypergeometric enrichment. Of the N occurrences of the collection, K are of the term and n fall into the record; the
score is -log10 of the probability of k or more of the term's occurrences in the record, computed exactly as a sum of
log-gamma terms in vectorised numpy, and adjusted for false discoveries within the record (Benjamini-Hochberg).

Cases: rows with a null key, or a count that is null or not positive, do not count; several rows of one (record, term)
are added up; a record of a single term has score 0 for it where it is the whole collection; ties go to the higher
count, then the lower term id; an empty table gives an empty result. The work is one aggregation by (record, term) and
two of its sums; a hot term or record is pre-aggregated before each shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0, by Stirling's series after shifting x to 10 or more; 1e-13 relative."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(10):
        low = y < 10
        if not low.any():
            break
        shift[low] += np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def log_upper_tail(k: np.ndarray, n: np.ndarray, big_k: np.ndarray, big_n: np.ndarray) -> np.ndarray:
    """ln P(X >= k) for X hypergeometric: n draws from big_n of which big_k count.

    Below the mean the complement is summed, so that the sum always runs away from the mode and ends early.
    """
    k, n, big_k, big_n = (np.asarray(v, np.float64) for v in (k, n, big_k, big_n))
    low, high = np.maximum(0, n + big_k - big_n), np.minimum(n, big_k)
    ln_c = lambda a, b: log_gamma(a + 1) - log_gamma(b + 1) - log_gamma(a - b + 1)

    def pmf(at: np.ndarray) -> np.ndarray:
        x, draws, marked, all_ = i[at], n[at], big_k[at], big_n[at]
        return ln_c(marked, x) + ln_c(all_ - marked, draws - x) - ln_c(all_, draws)

    upper = k > n * big_k / np.maximum(big_n, 1)
    i = np.where(upper, k, k - 1)
    total = np.ones_like(k)
    term = np.ones_like(k)
    j = i.copy()
    active = (j < high) & upper | (j > low) & ~upper
    while active.any():
        a = np.flatnonzero(active)
        x, up = j[a], upper[a]
        ratio = np.where(
            up,
            (big_k[a] - x) * (n[a] - x) / np.maximum((x + 1) * (big_n[a] - big_k[a] - n[a] + x + 1), 1e-300),
            x * (big_n[a] - big_k[a] - n[a] + x) / np.maximum((big_k[a] - x + 1) * (n[a] - x + 1), 1e-300),
        )
        term[a] *= ratio
        total[a] += term[a]
        j[a] += np.where(up, 1, -1)
        active[a] = (term[a] > total[a] * 1e-17) & np.where(up, j[a] < high[a], j[a] > low[a])
    out = np.zeros_like(k)
    sure = k <= low
    inside = ~sure & (k <= high)
    ln = np.full_like(k, -np.inf)
    ok = inside & (i >= low) & (i <= high)
    ln[ok] = pmf(ok) + np.log(total[ok])
    out[inside] = np.where(upper[inside], ln[inside], np.log1p(-np.minimum(np.exp(ln[inside]), 1 - 1e-16)))
    out[~sure & (k > high)] = -np.inf
    return np.minimum(out, 0.0)


def term_scores(counts: DataFrame, record: list[str], term: str = "term_id", count: str = "count", reported: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(record..., term, k, n, all_k, all_n, score, rank, adjusted) of every term of every record; `record[0]` names the collection.

    `reported` keeps the rows of the records to be scored; all records count in the collection's sums.
    """
    collection = record[0]
    base = counts.where(F.col(count) > 0).dropna(subset=[*record, term]).groupBy(*record, term).agg(F.sum(count).cast("long").alias("k"))
    per_record = Window.partitionBy(*record)
    sized = base.withColumn("n", F.sum("k").over(per_record)).withColumn("m", F.count("*").over(per_record))
    per_term = base.groupBy(collection, term).agg(F.sum("k").alias("all_k"))
    whole = per_term.groupBy(collection).agg(F.sum("all_k").alias("all_n"))
    sized = reported(sized) if reported else sized
    rows = sized.join(per_term, [collection, term]).join(whole, collection)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["score"] = -log_upper_tail(f["k"], f["n"], f["all_k"], f["all_n"]) / np.log(10)
            yield f

    schema = rows.withColumn("score", F.lit(0.0)).schema
    scored = rows.mapInPandas(score, schema)
    # Benjamini-Hochberg: p * m / rank, made monotone from the largest p downwards
    by_rank = Window.partitionBy(*record).orderBy(F.desc("score"), F.desc("k"), term)
    ranked = scored.withColumn("rank", F.row_number().over(by_rank))
    raw = ranked.withColumn("raw", F.greatest(F.lit(0.0), F.col("score") - F.log10(F.col("m") / F.col("rank"))))
    upward = Window.partitionBy(*record).orderBy(F.desc("rank"))
    return raw.withColumn("adjusted", F.max("raw").over(upward)).drop("raw", "m")


def characteristic_terms(counts: DataFrame, record: list[str], term: str = "term_id", count: str = "count", reported: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(record..., term): the one term each record stands out by most, by its adjusted score.

    The adjustment keeps the order within a record and may make neighbours equal; those are told apart by the raw score, so
    the first term is that of rank 1.
    """
    return term_scores(counts, record, term, count, reported).where("rank = 1").select(*record, term)
