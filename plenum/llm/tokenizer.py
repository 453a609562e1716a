"""Problem 8: byte-level pair encoding of a whole corpus inside Spark expressions.

Texts are cut into words by the tokenizer's pattern. A word's bytes (as hex pairs) are folded by ranked merges: the pair
of least rank, leftmost first, is joined until no neighbouring pair has a rank. Only higher-order functions take part;
the ranks are a literal in the plan, spread over CRC buckets so that a lookup reads a handful of keys.

Every distinct word is counted over the whole corpus. The CACHE most frequent ones (a fixed bound) are folded once and
become a second literal. A rarer word falls apart into pieces at characters before which no token of the vocabulary
reaches over from another character, so no merge can cross there. It is read in chunks of CHUNK pieces: the most frequent
chunks, and the most frequent pieces of the others, are folded once as well and stand in the same literal; only a piece
beyond all three is folded where it stands. The cache decides the time, never the ids.

Cases: null and empty texts have an empty list; repeated rows of a key give one row; decoding the ids gives the text back.
"""

from __future__ import annotations

import base64
import json
import zlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the blanks of the pattern that splits text into words before merging.
_BLANK = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: That pattern: a contraction, letters, digits or signs with at most one blank before them, or blanks.
WORDS = rf"'(?:[stmd]|re|ve|ll)| ?(?:\p{{L}}++|\p{{N}}++|[^{_BLANK}\p{{L}}\p{{N}}]++)|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
BUCKETS = 1 << 14
#: Words, chunks and pieces that are looked up, of each so many; and pieces of a chunk.
CACHE, CHUNK = 20_000, 4
NONE = 0x7FFFFFFF


@lru_cache(maxsize=4)
def ranks(path: str = DEFAULT_RANKS) -> dict[str, int]:
    """Rank by token, tokens as upper-case hex of their bytes."""
    with open(path, "rb") as f:
        return {base64.b64decode(a).hex().upper(): int(b) for a, b in (line.split() for line in f if line.strip())}


def _bucketed(entries: dict[str, object], value_type: str) -> Column:
    """A literal array of maps, by CRC-32 of the key."""
    rows: list[dict[str, object]] = [{} for _ in range(BUCKETS)]
    for k, v in entries.items():
        rows[zlib.crc32(k.encode()) % BUCKETS][k] = v
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False, separators=(",", ":"))), f"array<map<string,{value_type}>>")


def _find(table: Column, key: Column) -> Column:
    return F.try_element_at(F.get(table, F.crc32(key.cast("binary")) % BUCKETS), key)


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_merges(word: Column, table: Column) -> Column:
    """The ids of one word: an expression of higher-order functions only."""
    rank = lambda x: F.coalesce(_find(table, x), F.lit(NONE))

    def step(state: Column, _: Column) -> Column:
        p, r = state["p"], state["r"]

        def join(at: Column) -> Column:
            def put(new: Column) -> Column:
                left = F.when(at > 1, F.array(rank(F.concat(F.get(p, at - 2), new)))).otherwise(F.expr("array()").cast("array<int>"))
                right = F.when(at < F.size(r), F.array(rank(F.concat(new, F.get(p, at + 1))))).otherwise(F.expr("array()").cast("array<int>"))
                return F.struct(
                    F.concat(F.slice(p, F.lit(1), at - 1), F.array(new), F.slice(p, at + 2, F.size(p))).alias("p"),
                    F.concat(F.slice(r, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(r, at + 2, F.size(r))).alias("r"),
                )

            return _let(F.concat(F.get(p, at - 1), F.get(p, at)), put)

        least = F.coalesce(F.array_min(r), F.lit(NONE))
        return F.when(least == NONE, state).otherwise(_let(F.array_position(r, least).cast("int"), join))

    def merged(h: Column) -> Column:
        n = F.length(h) / 2
        pieces = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.substring(h, i * 2 + 1, F.lit(2)))

        def start(p: Column) -> Column:
            pairs = F.when(F.size(p) > 1, F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x, i: rank(F.concat(x, F.get(p, i + 1))))).otherwise(F.expr("array()").cast("array<int>"))
            state = F.struct(p.alias("p"), pairs.alias("r"))
            return F.aggregate(F.slice(p, F.lit(1), F.size(p) - 1), state, step)["p"]

        return F.transform(_let(pieces, start), lambda x: _find(table, x))

    def whole(h: Column) -> Column:  # a word that is a token itself needs no fold
        return _let(_find(table, h), lambda x: F.when(x.isNotNull(), F.array(x)).otherwise(merged(h)))

    return _let(F.hex(F.encode(word, "utf-8")), whole)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


@lru_cache(maxsize=4)
def _pieces_pattern(path: str) -> str:
    """A pattern of runs that no merge can leave: a split stands before a character whose first byte follows no
    continuation byte in any token, where the character before is outside ASCII."""
    follow = set()
    for token in ranks(path):
        b = bytes.fromhex(token)
        follow.update(y for x, y in zip(b, b[1:]) if x >= 0x80 and y >= 0xC2)
    free = [b for b in range(0xE0, 0xF0) if b not in follow]
    if not free:
        return r"(?s)(?:.+){1,%d}"
    first = lambda b: "\\u%04x-\\u%04x" % (max(0x800, (b & 15) << 12), min(((b & 15) << 12) + 0xFFF, 0xFFFF))
    starts = "".join(first(b) for b in free)
    # a run of ASCII takes the next character along, whatever it is
    return rf"(?s)(?:(?:[\x00-\x7f]++.?|.)(?:[^{starts}\x00-\x7f]|[\x00-\x7f]++.?)*+){{1,%d}}"


def pieces(word: Column, path: str, most: int = 1) -> Column:
    """A word in chunks of up to `most` pieces, which are encoded apart."""
    return F.regexp_extract_all(word, F.lit(_pieces_pattern(path) % most), F.lit(0))


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of every distinct word of the corpus."""
    return df.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def spark_tasks(df: DataFrame) -> int:
    return max(2, df.sparkSession.sparkContext.defaultParallelism)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """(key, ids array<int>) of every row."""
    table = _bucketed(ranks(ranks_path), "int")
    source = df.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counts = cut(word_counts(source))
    most = lambda d: d.orderBy(F.desc("n"), "word").limit(CACHE).select("word")
    parts = lambda d, kept, size: d.join(kept, "word", "left_anti").select(F.explode(pieces(F.col("word"), ranks_path, size)).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    frequent = most(counts)
    chunks = cut(parts(counts, frequent, CHUNK))
    kept = most(chunks)
    single = most(parts(chunks, kept, 1))
    words_ = frequent.unionByName(kept).unionByName(single).distinct().repartition(spark_tasks(source), "word")
    known = words_.select("word", _let(table, lambda t: fold_merges(F.col("word"), t)).alias("ids"))
    cached = {r[0]: list(r[1]) for r in known.collect()}  # at most 3 * CACHE short rows
    tables = F.struct(table.alias("ranks"), _bucketed(cached, "array<int>").alias("cache"))

    def by_piece(chunk: Column, t: Column) -> Column:
        return F.flatten(F.transform(pieces(chunk, ranks_path), lambda p: F.coalesce(_find(t["cache"], p), fold_merges(p, t["ranks"]))))

    def by_chunk(w: Column, t: Column) -> Column:
        return F.flatten(F.transform(pieces(w, ranks_path, CHUNK), lambda c: F.coalesce(_find(t["cache"], c), by_piece(c, t))))

    # each literal stands once in the plan, as the argument of the outermost function
    ids = _let(tables, lambda t: F.flatten(F.transform(words(F.col("text")), lambda w: F.coalesce(_find(t["cache"], w), by_chunk(w, t)))))
    return source.select(key, ids.alias("ids"))


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """(key, text) of every row: the tokens' binary pieces, concatenated. Ids outside the vocabulary give a null text."""
    pieces = [""] * (max(ranks(ranks_path).values()) + 1)
    for token, n in ranks(ranks_path).items():
        pieces[n] = token
    table = F.split(F.lit(",".join(pieces)), ",")
    text = F.decode(F.unhex(F.concat_ws("", F.transform(F.col(ids), lambda i: F.get(table, i)))), "utf-8")
    known = ~F.exists(F.col(ids), lambda i: F.get(table, i).isNull() | (F.get(table, i) == ""))
    return df.select(key, F.when(known, text).alias("text"))
