"""Queries over the operators of this folder: name -> (spark, folder of tables) -> DataFrame, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tokenize
from ..session import short_list
from . import enrichment, frequency, leakage, linkage, lookalike, sentences, spans, tokenizer, turns, variants


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = turns.dialogue_turns(_t(spark, d, "speeches"), _t(spark, d, "persons"), _t(spark, d, "person_aliases"))
    return rows.select("speech_id", "turn_no", "person_id")


def p1_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns.speaker_turns(_t(spark, d, "speeches"), _t(spark, d, "persons"), _t(spark, d, "person_aliases"))


def _p2_counts(spark: SparkSession, d: str) -> DataFrame:
    meetings = _t(spark, d, "meeting_terms").select(F.lit("meeting").alias("record_kind"), F.col("meeting_id").alias("record_id"), "term_id", "count")
    persons = _t(spark, d, "member_terms").select(F.lit("person").alias("record_kind"), F.col("person_id").alias("record_id"), "term_id", "count")
    return meetings.unionByName(persons)


def _p2_records(spark: SparkSession, d: str) -> DataFrame:
    """The records that are reported: every meeting, and persons with at least ten speeches."""
    often = _t(spark, d, "speeches").where("person_id is not null").select("id", "person_id").distinct().groupBy("person_id").agg(F.count("*").alias("n")).where("n >= 10")
    return often.select(F.lit("person").alias("record_kind"), F.col("person_id").alias("record_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    reported = _p2_records(spark, d).withColumn("listed", F.lit(True))
    found = enrichment.characteristic_terms(_p2_counts(spark, d), ["record_kind", "record_id"], reported=lambda rows: rows.join(reported, ["record_kind", "record_id"], "left").where("record_kind = 'meeting' or listed").drop("listed"))
    return found.select("record_kind", "record_id", F.col("term_id").cast("int").alias("term_id"))


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    return enrichment.term_scores(_p2_counts(spark, d), ["record_kind", "record_id"]).select("record_kind", "record_id", "term_id", F.col("k").alias("occurrences"), F.round("score", 6).alias("score"), F.round("adjusted", 6).alias("adjusted"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.same_person_pairs(_t(spark, d, "persons"), _t(spark, d, "person_aliases"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return frequency.marks(_t(spark, d, "speech_terms"), _t(spark, d, "terms"))


def p4_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return frequency.term_frequencies(_t(spark, d, "speech_terms"))


def p4_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """One- and two-word grams of the Latin words of all documents."""
    tokens = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), F.lower)
    grams = frequency.ngram_counts(_t(spark, d, "documents").select("doc_id", tokens.alias("tokens")), "doc_id", "tokens", 2)
    return grams.select("n", F.concat_ws(" ", "gram").alias("gram"), "occurrences", "records")


def p4_token_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Grams of one to five words of all documents, Thai and Latin."""
    words = {r[0]: 1000 for r in short_list(_t(spark, d, "terms").select("term").where("term is not null").distinct(), 200_000)}
    docs = tokenize.thai_tokens(_t(spark, d, "documents").dropDuplicates(["doc_id"]).select("doc_id", "text"), "text", tokenize.Lexicon(words))
    grams = frequency.ngram_counts(docs.select("doc_id", "tokens"), "doc_id", "tokens", 5)
    return grams.select("n", F.concat_ws(" ", "gram").alias("gram"), "occurrences", "records")


def p4_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Every run of more than eight words, of any length, that stands at more than one place in the documents."""
    words = {r[0]: 1000 for r in short_list(_t(spark, d, "terms").select("term").where("term is not null").distinct(), 200_000)}
    docs = tokenize.thai_tokens(_t(spark, d, "documents").dropDuplicates(["doc_id"]).select("doc_id", "text"), "text", tokenize.Lexicon(words))
    grams = frequency.ngram_counts(docs.select("doc_id", "tokens"), "doc_id", "tokens", least=2)
    return grams.where(F.col("n") > frequency.STEP).select("n", F.concat_ws(" ", "gram").alias("gram"), "occurrences", "records")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(_t(spark, d, "speech_segments"), ["segment_id", "part"]).select("segment_id", "part").distinct()


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_share(_t(spark, d, "speech_segments"), ["segment_id", "part"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_matches(spark, d).select("member_no", "person_id")


def p6_matches(spark: SparkSession, d: str) -> DataFrame:
    return linkage.match(_t(spark, d, "members"), _t(spark, d, "persons"), _t(spark, d, "person_aliases"), _t(spark, d, "speeches"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_ends(_t(spark, d, "speeches"), _t(spark, d, "terms"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(_t(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every document's id and whether decoding its ids gives its text back."""
    docs = _t(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    back = tokenizer.decode(tokenizer.encode(_t(spark, d, "documents")))
    return back.select("doc_id", F.sha2("text", 256).alias("b")).join(docs, "doc_id").select("doc_id", (F.col("b") == F.col("h")).alias("same"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_passages(spark, d).select("doc_id", "item_id")


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_look_pairs(_t(spark, d, "documents"))


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.common_form(_t(spark, d, "documents"), "doc_id").select("doc_id", "form_hash")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_turns, p2_found, p2_scores, p3_found, p4_found, p4_frequencies, p4_ngrams, p4_token_ngrams, p4_repeats, p5_found, p5_shares,
        p6_found, p6_matches, p7_found, p8_ids, p8_decoded, p9_found, p9_passages, p10_found, p10_forms,
    )
}

_FREQUENCIES = """
SELECT term_id, CAST(SUM(count) AS BIGINT) AS occurrences, COUNT(*) AS records
FROM (SELECT speech_id, term_id, MAX(count) AS count FROM speech_terms WHERE count > 0 AND speech_id IS NOT NULL AND term_id IS NOT NULL GROUP BY ALL)
GROUP BY term_id
"""

ORACLE: dict[str, str] = {
    "p4_frequencies": _FREQUENCIES,
    "p4_found": f"""
WITH f AS ({_FREQUENCIES}), n AS (SELECT COUNT(DISTINCT speech_id) AS total FROM speech_terms WHERE count > 0),
m AS (SELECT term_id, CASE WHEN occurrences < 3 OR records < 2 THEN 'rare' WHEN records > total * 0.1 THEN 'common' END AS mark
      FROM f CROSS JOIN n WHERE term_id IN (SELECT id FROM terms GROUP BY id HAVING NOT MAX(COALESCE(is_stopword, FALSE))))
SELECT term_id, mark FROM m WHERE mark IS NOT NULL""",
    "p5_found": """
WITH r AS (SELECT DISTINCT segment_id, part, text FROM speech_segments WHERE length(text) >= 100),
w AS (SELECT DISTINCT segment_id, part, unnest(list_transform(range(1, CAST(length(text) - 98 AS BIGINT)), lambda i: md5(substr(text, i, 100)))) AS s FROM r)
SELECT DISTINCT segment_id, part FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING COUNT(*) > 1)""",
    "p5_shares": """
WITH r AS (SELECT DISTINCT segment_id, part, text FROM speech_segments WHERE length(text) >= 100),
w AS (SELECT segment_id, part, unnest(range(1, CAST(length(text) - 98 AS BIGINT))) AS i, unnest(list_transform(range(1, CAST(length(text) - 98 AS BIGINT)), lambda i: md5(substr(text, i, 100)))) AS s FROM r),
k AS (SELECT segment_id, part, i FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING COUNT(DISTINCT (segment_id, part)) > 1)),
n AS (SELECT *, CASE WHEN i <= LAG(i) OVER o + 100 THEN 0 ELSE 1 END AS first FROM k WINDOW o AS (PARTITION BY segment_id, part ORDER BY i)),
g AS (SELECT *, SUM(first) OVER (PARTITION BY segment_id, part ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM n),
x AS (SELECT segment_id, part, span, MAX(i) - MIN(i) + 100 AS chars FROM g GROUP BY ALL)
SELECT segment_id, part, COUNT(*) AS spans, CAST(SUM(chars) AS BIGINT) AS shared_chars FROM x GROUP BY ALL""",
    "p8_decoded": "SELECT doc_id, TRUE AS same FROM documents",
    "p4_ngrams": """
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x)) AS t FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
g AS (SELECT doc_id, 1 AS n, unnest(t) AS gram FROM d
      UNION ALL SELECT doc_id, 2, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM d WHERE len(t) > 1)
SELECT CAST(n AS INTEGER) AS n, gram, COUNT(*) AS occurrences, COUNT(DISTINCT doc_id) AS records FROM g GROUP BY n, gram""",
}
