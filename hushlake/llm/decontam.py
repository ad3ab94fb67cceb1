"""Benchmark decontamination by spaced-seed hashing, in DataFrame expressions only.

A mask such as ``11011011`` picks the words of a window whose positions count;
the others may have been replaced. Windows of benchmark items and of documents
meet on the hash of their picked words, and each hit is verified along its
diagonal (document position minus item position), where substituted words count
against the match. Text is never cut: every window of every text is hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seed masks; 1: the word counts, 0: it may differ. Together they hit every overlap that the thresholds accept (tried for all substitutions in 10 to 25 words; a longer one has such a part).
MASKS = ("11011011", "1110010111", "11110011", "111111", "110101011")
#: An overlap needs so many equal words (all words of an item that has fewer).
MIN_MATCH = 10
#: Share of equal words over the whole overlap of document and item.
MIN_IDENTITY = 0.8
#: A run along the diagonal gains 1 for an equal word and loses this for another one.
PENALTY = 3
#: Bytes of the benchmark's seeds that are sent to every executor; more are joined by a shuffle. Each row has a hash, an id, a hash of the item and a position.
MAX_BROADCAST, ROW_BYTES = 96 << 20, 64


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and all non-ASCII characters; empty for null."""
    flat = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " ", -1))


def seeds(df: DataFrame, keep: list[str], masks: tuple[str, ...]) -> DataFrame:
    """``keep`` columns, position ``i`` and hash ``h`` of every seed of the array column ``w``."""
    span = max(map(len, masks))
    size = F.size("w")
    shifted = [F.slice("w", k + 1, F.greatest(size - k, F.lit(0))).alias(f"w{k}") for k in range(span)]
    windows = df.where(size >= min(map(len, masks))).select(*keep, F.inline(F.arrays_zip(F.sequence(F.lit(0), size - 1).alias("i"), *shifted)))
    hashes = [F.when(F.col(f"w{len(m) - 1}").isNotNull(), F.xxhash64(F.lit(m), *[F.col(f"w{j}") for j, bit in enumerate(m) if bit == "1"])) for m in masks]
    return windows.select(*keep, "i", F.explode(F.array(*hashes)).alias("h")).where("h IS NOT NULL")


def _verified(doc: Column, item: Column, diagonal: Column) -> Column:
    """struct<matched, overlap, best>: equal words and length of the overlap, and equal words of its best run."""
    begin = F.greatest(-diagonal, F.lit(0))
    length = F.least(F.size(item), F.size(doc) - diagonal) - begin
    same = F.zip_with(F.slice(doc, diagonal + begin + 1, length), F.slice(item, begin + 1, length), lambda a, b: a == b)
    zero = F.struct(*[F.lit(0).alias(c) for c in ("matched", "overlap", "run", "hits", "top", "best")])

    def step(s: Column, eq: Column) -> Column:
        run = F.when(eq, F.greatest(s["run"], F.lit(0)) + 1).otherwise(s["run"] - PENALTY)
        hits = F.when(eq, F.when(s["run"] > 0, s["hits"]).otherwise(0) + 1).otherwise(s["hits"])
        return F.struct(
            (s["matched"] + eq.cast("int")).alias("matched"), (s["overlap"] + 1).alias("overlap"), run.alias("run"), hits.alias("hits"),
            F.greatest(s["top"], run).alias("top"), F.when(run > s["top"], hits).otherwise(s["best"]).alias("best"),
        )

    return F.aggregate(same, zero, step)


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_match: int = MIN_MATCH, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``(doc_id, item_id, matched, overlap)`` for each document and each benchmark item that it holds, the widest overlap of the pair.

    Nulls and empty texts match nothing. An item shorter than the shortest mask is
    sought as the sequence of all its words.
    Rows that share a doc_id (a null is an id as well) count as one document;
    of tied overlaps the figures are equal, so ties need no choice. Texts of any
    length are hashed whole; extra columns aren't read. Empty tables give an
    empty result.
    """
    # Rows are told apart by id and text, so rows that share an id, or have none, don't meet each other's hits.
    d = docs.select("doc_id", F.xxhash64("text").alias("of_doc"), "text")
    items = benchmark.select("item_id", F.xxhash64("text").alias("of_item"), words(F.col("text")).alias("w")).distinct()
    shortest = min(map(len, masks))
    short = {"1" * n: n for (n,) in items.select(F.size("w")).distinct().collect() if 0 < n < shortest}  # a mask for each length, of which there are few
    keyed = seeds(items, ["item_id", "of_item"], masks)
    for mask, n in short.items():
        keyed = keyed.union(seeds(items.where(F.size("w") == n), ["item_id", "of_item"], (mask,)))
    keyed = keyed.withColumnRenamed("i", "at")
    most = max_broadcast // ROW_BYTES
    if keyed.limit(most + 1).count() <= most:
        keyed = F.broadcast(keyed)
    found = seeds(d.select("doc_id", "of_doc", words(F.col("text")).alias("w")), ["doc_id", "of_doc"], (*masks, *short)).join(keyed, "h")
    # The narrow hits come to one for each diagonal before any text is fetched.
    found = found.select("doc_id", "of_doc", "item_id", "of_item", (F.col("i") - F.col("at")).alias("diagonal")).distinct()
    f, t = found.alias("f"), items.withColumnRenamed("w", "item").alias("t")
    hits = f.join(t, (F.col("f.of_item") == F.col("t.of_item")) & F.col("f.item_id").eqNullSafe(F.col("t.item_id"))).select("f.doc_id", "f.of_doc", "f.item_id", "f.diagonal", "t.item").alias("g")
    hits = hits.join(d.alias("d"), (F.col("g.of_doc") == F.col("d.of_doc")) & F.col("g.doc_id").eqNullSafe(F.col("d.doc_id"))).select("g.doc_id", "g.item_id", "g.diagonal", "g.item", words(F.col("d.text")).alias("w"))
    # A column that isn't deterministic keeps the verification out of the join's condition, which has no generated code.
    hits = hits.select("*", F.monotonically_increasing_id().alias("hit")).where("hit >= 0")
    v = hits.select("doc_id", "item_id", F.size("item").alias("m"), _verified(F.col("w"), F.col("item"), F.col("diagonal")).alias("v"))
    need = F.least(F.lit(min_match), F.col("m"))
    whole = (F.col("v.matched") >= need) & (F.col("v.matched") >= MIN_IDENTITY * F.col("v.overlap"))
    best = F.max(F.struct("v.matched", "v.overlap")).alias("best")
    return v.where(whole | (F.col("v.best") >= need)).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("best.matched").cast("long").alias("matched"), F.col("best.overlap").cast("long").alias("overlap"))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; rows that share a ``key`` count as one document."""
    leaked = overlaps(docs.select(F.col(key).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("leaked_id")).distinct()
    return docs.join(leaked, docs[key].eqNullSafe(leaked["leaked_id"]), "left_anti")
