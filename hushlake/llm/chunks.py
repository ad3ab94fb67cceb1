"""Substring dedup by content-defined chunking with a gear rolling hash.

The gear hash of the last 16 bytes is rolled over each text, and a text is cut
behind every byte whose hash is the least of its neighbourhood (the local-extremum
form of the cut rule: cuts depend on 40 bytes at most, chunks are 25 to some 100
bytes long, and an insertion moves only the cuts beside it). A chunk whose digest
also occurs in a document with a smaller id is a duplicate. Adjacent duplicates
are a run, which is extended byte by byte to both sides against the text that
holds its outer chunks, and reported if it makes up a passage or the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from hushlake.llm.common import importable, scratch, stored

#: A cut's hash is the least of so many on either side. Between two cuts without any (constant runs) a chunk ends after LONGEST bytes.
REACH, LONGEST = 24, 2048
#: An extended run of duplicate chunks counts from so many bytes, and at any length where it is the whole text.
LEAST_SPAN = 100
#: Where texts agree for so many bytes beyond the next chunk (16 of the hash and REACH, with some to spare), they share its cut, and it would be of the run.
BEYOND = 64
#: Text bytes that are cut at a time.
AT_ONCE = 1 << 22


def _gear() -> np.ndarray:
    """A random number for each byte value, by splitmix64 from 1."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def gear_hash(data: np.ndarray) -> np.ndarray:
    """Rolling hash of the 16 bytes that end at each byte: h = (h << 1) + GEAR[byte], by doubling."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        ahead = h[k:] + (h[:-k] << np.uint32(k))
        h = np.concatenate([h[:k], ahead])
    return h


def cuts(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one text; the last is the text's end."""
    n = len(data)
    if n <= REACH:
        return np.array([n], np.int64) if n else np.empty(0, np.int64)
    h = gear_hash(data)
    padded = np.concatenate([np.full(REACH, 0xFFFFFFFF, np.uint32), h, np.full(REACH + 1, 0xFFFFFFFF, np.uint32)])
    m, width = padded, 1
    while width * 2 <= REACH:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    m = np.minimum(m[: len(m) - (REACH - width)], m[REACH - width :])  # least of REACH from each place on
    ends = np.flatnonzero((h < m[:n]) & (h <= m[REACH + 1 : REACH + 1 + n])) + 1
    ends = np.unique(np.append(ends, n))
    gaps = np.diff(ends, prepend=0)
    if gaps.max() > LONGEST:
        ends = np.concatenate([np.append(np.arange(e - g + LONGEST, e, LONGEST), e) for e, g in zip(ends, gaps, strict=True)])
    return ends


def chunk_rows(df: DataFrame) -> DataFrame:
    """``(doc_id, hi, lo, start, sizes, leads, led)``: the 128-bit digest and place of every chunk in bytes, and 16 bits each of its size and of those before and after it (0: none).

    Some megabytes of text are cut together. Of their places of a digest the first
    by doc_id and start ``leads``, and those of one that has others are ``led``.
    Null and empty texts have no chunks.
    """
    importable(df.sparkSession)
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest

        def chunked(ids: pa.Array, parts: list) -> pa.RecordBatch:
            ids = ids.take(pa.array([p[0] for p in parts]))
            sums = np.frombuffer(b"".join(p[1] for p in parts), ">i8").astype(np.int64).reshape(-1, 2)
            start = np.concatenate([p[2] for p in parts])
            packed = np.concatenate([(s << 32) + (np.append(0, s[:-1]) << 16) + np.append(s[1:], 0) for s in (p[3] for p in parts)])
            row = np.repeat(np.arange(len(parts)), [len(p[2]) for p in parts])
            leads, led = _leaders(sums, np.asarray(pc.rank(ids, tiebreaker="min"))[row], start)
            columns = [ids.take(pa.array(row)), *map(pa.array, (sums[:, 0].copy(), sums[:, 1].copy(), start.astype(np.int32), packed, leads, led))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "hi", "lo", "start", "sizes", "leads", "led"])

        for batch in batches:
            parts, held = [], 0
            for k, raw in enumerate(batch.column(1)):
                raw = raw.as_buffer() if raw.is_valid else b""
                if not len(raw):
                    continue
                ends = cuts(np.frombuffer(raw, np.uint8))
                starts, raw = np.concatenate([[0], ends[:-1]]), memoryview(raw)
                parts.append((k, b"".join([digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), starts, ends - starts))
                held += len(raw)
                if held > AT_ONCE:
                    yield chunked(batch.column(0), parts)
                    parts, held = [], 0
            if parts:
                yield chunked(batch.column(0), parts)

    return df.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, hi long, lo long, start int, sizes long, leads boolean, led boolean")


def _leaders(sums: np.ndarray, rank: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: whether it is the first of its digest by rank and start, and whether its digest has other rows."""
    order = np.lexsort((start, rank, sums[:, 1], sums[:, 0]))
    new = np.append(True, (np.diff(sums[order, 0]) != 0) | (np.diff(sums[order, 1]) != 0))
    leads, led = np.empty(len(order), bool), np.empty(len(order), bool)
    leads[order], led[order] = new, ~(new & np.append(new[1:], True))
    return leads, led


def _in_common() -> Column:
    """Bytes that ``ours`` and ``theirs`` have in common at their end (``left``) or at their start, by halving."""

    def longer(n: Column, k: Column) -> Column:
        def piece(c: str) -> Column:
            return F.substring(F.col(c), F.when(F.col("left"), F.octet_length(c) - n - k).otherwise(n) + 1, k)

        fits = n + k <= F.least(F.octet_length("ours"), F.octet_length("theirs"))
        return F.when(fits & (piece("ours") == piece("theirs")), n + k).otherwise(n)

    bits = (2 * LONGEST + BEYOND).bit_length()  # of the longest edge
    return F.aggregate(F.array(*[F.lit(1 << b) for b in reversed(range(bits))]), F.lit(0), longer)


def _extended(df: DataFrame, runs: DataFrame) -> DataFrame:
    """``runs`` with start and end moved outwards as far as the text agrees with that of the smallest document that holds the outer chunk."""
    raw = df.select("doc_id", F.col("text").cast("binary").alias("raw"))
    kept = ["doc_id", "run", "start", "end", "n_chunks", "first_doc_id"]
    sides = F.array(F.struct(F.lit(True).alias("left"), "head.*"), F.struct(F.lit(False).alias("left"), "tail.*"))
    edges = runs.select(*kept, F.inline(sides))
    # An edge is the outer chunk with what may be in common beyond it.
    begin = F.when(F.col("left"), F.greatest(F.col("chunk") - F.col("before") - BEYOND, F.lit(0))).otherwise(F.col("chunk"))
    length = F.when(F.col("left"), F.col("chunk") - begin + F.col("size")).otherwise(F.col("size") + F.col("after") + BEYOND)
    edges = edges.withColumn("length", length).withColumn("begin", begin)
    # Both joins read the same exchange of the texts, and neither sorts it. Other rows of an id don't hold the chunk there, and go.
    ours = edges.hint("shuffle_hash").join(raw, "doc_id").select(*kept, F.octet_length("raw").alias("total"), "left", "size", "holder", "length", (F.col("begin") + F.col("held_at") - F.col("chunk")).alias("at"), F.substring("raw", F.col("begin") + 1, F.col("length")).alias("ours"))
    theirs = F.substring("t.raw", F.greatest(F.col("at"), F.lit(0)) + 1, F.col("length") + F.least(F.col("at"), F.lit(0)))
    kept = [*kept, "total"]
    both = ours.alias("o").hint("shuffle_hash").join(raw.alias("t"), F.col("o.holder") == F.col("t.doc_id")).select("o.left", "o.size", "o.ours", theirs.alias("theirs"), *[f"o.{c}" for c in kept])
    more = both.select(*kept, "left", (_in_common() - F.col("size")).alias("more")).where("more >= 0")
    out = more.groupBy(*kept).agg(*[F.coalesce(F.max(F.when(F.col("left") == side, F.col("more"))), F.lit(0)).alias(name) for name, side in (("down", True), ("up", False))])
    return out.select("doc_id", (F.col("start") - F.col("down")).alias("start"), (F.col("end") + F.col("up")).alias("end"), "n_chunks", "first_doc_id", "total")


def _opens() -> tuple[Column, WindowSpec]:
    """1 where a span begins that doesn't touch those before it in its document, and the order for its sum."""
    in_order = Window.partitionBy("doc_id").orderBy("start", "end", "first_doc_id")
    return F.coalesce((F.col("start") > F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1)), in_order.rowsBetween(Window.unboundedPreceding, 0)


def repeated_spans(df: DataFrame, least: int = LEAST_SPAN) -> DataFrame:
    """``(doc_id, start, end, n_chunks, first_doc_id)``: each passage of at least ``least`` bytes, or text of any length, that smaller doc_ids hold too.

    A passage is found by the whole chunks it shares, and extended to both sides
    against the smallest document that holds its outer chunk. Places are bytes of
    the UTF-8 text; ``first_doc_id`` is the smallest document that holds the first
    chunk of the passage. Texts repeated within their document, and rows that
    share a doc_id, aren't duplicates of each other. Rows with a null doc_id, text
    or an empty text have no passages. A digest's first places in each part of the
    texts meet at one task, and the rest, which can be many more, get the first of
    all by an equi-join whose hot keys are split.
    """
    with scratch(df.sparkSession):
        df = df.where("doc_id IS NOT NULL").select("doc_id", "text")
        with scratch(df.sparkSession):  # the exchange of all chunks goes before the texts are exchanged
            again = stored(_again(df), result=True)
        return stored(_spans(df, again, least), result=True)


def _again(df: DataFrame) -> DataFrame:
    """``(doc_id, start, sizes, first_doc_id, held_at)``: the chunks that a smaller doc_id holds too, and the smallest place of each."""
    chunks = chunk_rows(df)
    by_digest = Window.partitionBy("hi", "lo").orderBy("doc_id", "start")
    every = by_digest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leaders = chunks.where("leads").select("doc_id", "hi", "lo", "start", "sizes", F.max("led").over(every).alias("led"), F.first("doc_id").over(every).alias("first_doc_id"), F.first("start").over(every).alias("held_at"), F.row_number().over(by_digest).alias("nth"))
    later = F.col("doc_id") > F.col("first_doc_id")
    leaders = stored(leaders.where(later | F.col("led") & (F.col("nth") == 1)))
    first = leaders.where("led AND nth = 1").select("hi", "lo", "first_doc_id", "held_at")
    rest = chunks.where("NOT leads").select("doc_id", "hi", "lo", "start", "sizes").join(first, ["hi", "lo"])
    kept = ["doc_id", "start", "sizes", "first_doc_id", "held_at"]
    return leaders.where(later).select(kept).union(rest.where(later).select(kept))


def _spans(df: DataFrame, again: DataFrame, least: int) -> DataFrame:
    """The passages that are made up by the chunks in ``again``."""
    size, before, after = (F.shiftright("sizes", k).bitwiseAND(0xFFFF).cast("int") for k in (32, 16, 0))
    again = again.repartition("doc_id").distinct().withColumn("end", (F.col("start") + size).cast("int"))
    opens, to_here = _opens()
    runs = again.withColumn("opens", opens).withColumn("run", F.sum("opens").over(to_here))
    chunk = F.struct(F.col("start").alias("chunk"), size.alias("size"), before.alias("before"), after.alias("after"), F.col("first_doc_id").alias("holder"), "held_at")
    runs = runs.groupBy("doc_id", "run").agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), F.count("*").alias("n_chunks"), F.min(F.struct("start", "first_doc_id")).alias("f"), F.min(chunk).alias("head"), F.max(F.struct("end", chunk.alias("chunk"))).alias("l"))
    runs = runs.select("doc_id", "run", "start", "end", "n_chunks", F.col("f.first_doc_id").alias("first_doc_id"), "head", F.col("l.chunk").alias("tail"))
    spans = _extended(df, runs).where((F.col("end") - F.col("start") >= least) | (F.col("start") == 0) & (F.col("end") == F.col("total")))
    opens, to_here = _opens()
    spans = spans.withColumn("opens", opens).withColumn("run", F.sum("opens").over(to_here))
    out = spans.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_chunks").alias("n_chunks"), F.min(F.struct("start", "first_doc_id")).alias("f"))
    return out.select("doc_id", "start", "end", "n_chunks", F.col("f.first_doc_id").alias("first_doc_id"))
