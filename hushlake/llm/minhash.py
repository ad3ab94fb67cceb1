"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

For each element of a set, SuperMinHash walks a random permutation of the
components: the value at step j is j plus a random fraction, so the components
of a signature are correlated and vary less than independent minima, and a set is
done as soon as its worst component is below the next step. Bands of components
make buckets; the members of a bucket are first compared with its least member
only, which already connects groups of copies with a row for each member. What a
bucket still holds in different components is compared next, if a sketch of one
bit for each component allows a link. Every link is confirmed on the full
sets, and components come from alternating star contraction of the links, a
distributed union-find.

A bucket of more than FEW items is never compared pair by pair. Its items are
described by their difference from the majority set of the crowd, the items of
all buckets with the same largest component. Two sets of sizes m and n, differences D and E, and
percentage p are linked just if

    2 (100 + p) |D & E| >= [(100 + p) |D| - (100 - p) m] + [(100 + p) |E| - (100 - p) n]

The brackets are an item's excess. The item of the least excess is linked to all
whose excess is at most its negative; each other item needs differences in common
with any partner, and at least a known number, so a join on the rarest ones (a
prefix filter) finds all its links. What copies have in common is in no
difference, so the join meets only items that were changed alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.llm.common import LOWER, UPPER, importable, scratch, stored

BANDS, ROWS = 28, 5
COMPONENTS = BANDS * ROWS
#: A sketch has a bit for each of the first 128 components. Bits beyond the mean of the least similar linked sets by so many deviations rule a link out.
DEVIATIONS = 6
#: Items of a bucket that are compared pair by pair.
FEW = 32
#: Ways in which a hot key is split.
SALTS = 16
#: Elements whose permutations are held at a time.
AT_ONCE = 150_000
_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = 3) -> np.ndarray:
    """Sorted 64-bit hashes of a text's word shingles; fewer words make one, none make none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TO_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mix(out * _M1 + h[k : len(h) - size + 1 + k])
    return np.unique(out)


def signatures(sets: list[np.ndarray], m: int = COMPONENTS) -> np.ndarray:
    """SuperMinHash signatures (one row of ``m`` numbers for each non-empty set)."""
    sizes = np.array([len(s) for s in sets])
    x = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), sizes)
    out = np.full((len(sets), m), np.inf)
    flat = out.ravel()
    order = None
    for j in range(m):
        r = _mix(x + np.uint64((2 * j + 1) * int(_M1) & 0xFFFFFFFFFFFFFFFF))
        value = (r >> np.uint64(32)).astype(np.float64) * 2.0**-32 + j
        pick = j + ((r & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if order is None:
            at = pick
        else:
            i = np.arange(len(x))
            at = order[i, pick].astype(np.int64)
            order[i, pick] = order[i, j]
        np.minimum.at(flat, row * m + at, value)
        open_ = out.max(axis=1) >= j + 1
        if not open_.any():
            break
        keep = open_[row]
        if order is None:  # after the first step the element's permutation has 0 where it took its pick
            x, row, pick = x[keep], row[keep], pick[keep]
            order = np.broadcast_to(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(x), m)).copy()
            order[np.arange(len(x)), pick] = 0
        elif keep.mean() < 0.7:
            x, row, order = x[keep], row[keep], order[keep]
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands, one column each; the band's number is part of its key."""
    part = np.ascontiguousarray(sig[:, : BANDS * ROWS]).view(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS))
    for k in range(ROWS):
        key = _mix(key * _M1 + part[:, :, k])
    return key.view(np.int64)


def sketches(sig: np.ndarray) -> np.ndarray:
    """One bit of a hash of each of 128 components, in two numbers."""
    bits = (_mix(np.ascontiguousarray(sig[:, :128]).view(np.uint64)) >> np.uint64(63)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def described(df: DataFrame, size: int = 3) -> DataFrame:
    """``(doc_id, t, n, item, bands, s0, s1)`` of each row; ``item`` digests the whole set, and is null without one; ``t`` hashes the text."""
    importable(df.sparkSession)
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(ids: list, texts: list, sets: list[np.ndarray]) -> pd.DataFrame:
            full = [k for k, s in enumerate(sets) if len(s)]
            sig = signatures([sets[k] for k in full])
            items, keys, sketch = [None] * len(sets), [None] * len(sets), np.zeros((len(sets), 2), np.int64)
            for k, b, s in zip(full, bands(sig), sketches(sig), strict=True):
                items[k], keys[k], sketch[k] = xxhash.xxh3_128_digest(sets[k].tobytes()), b, s
            return pd.DataFrame({"doc_id": pd.Series(ids, dtype=object), "t": texts, "n": [len(s) for s in sets], "item": items, "bands": keys, "s0": sketch[:, 0], "s1": sketch[:, 1]})

        for batch in batches:
            ids, texts, sets, held = [], [], [], 0
            for doc_id, t, text in zip(batch["doc_id"], batch["t"], batch["text"], strict=True):
                ids.append(None if pd.isna(doc_id) else doc_id)
                texts.append(t)
                sets.append(shingles(text, size))
                held += len(sets[-1])
                if held > AT_ONCE:
                    yield frame(ids, texts, sets)
                    ids, texts, sets, held = [], [], [], 0
            if ids:
                yield frame(ids, texts, sets)

    return df.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInPandas(run, f"doc_id {kind}, t long, n long, item binary, bands array<long>, s0 long, s1 long")


def _sets(df: DataFrame, size: int) -> DataFrame:
    """``(item, elements)`` of the rows of (doc_id, text, item) whose text has that item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                sets = [shingles(t, size) for t in part["text"]]
                rows = [(bytes(i), s.view(np.int64)) for i, s in zip(part["item"], sets, strict=True) if xxhash.xxh3_128_digest(s.tobytes()) == bytes(i)]
                yield pd.DataFrame(rows, columns=["item", "elements"])

    return df.select("text", "item").mapInPandas(run, "item binary, elements array<long>").dropDuplicates(["item"])


def components(links: DataFrame) -> DataFrame:
    """``(item, label)`` for each end of ``links (a, b)``: the least item of its component.

    Alternates large and small stars until nothing changes; the number of rounds
    grows with the logarithm of the longest path. Each round's links are a
    written table. An empty table of links gives an empty result.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("item"), F.col("b").alias("label"))

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs if not large else pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        if large:  # the hub of a star has a row for each of its ends: they are dealt out
            split = least.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
            met = both.withColumn("salt", F.pmod(F.hash("b"), F.lit(SALTS))).join(split, ["a", "salt"])
            return met.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        met = both.join(least, "a")
        return met.select("b", "low").union(least.select("a", "low")).toDF("a", "b").where("a <> b").distinct()

    mark = None
    while True:
        edges = stored(star(star(edges, True), False))
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("item"), F.col("b").alias("label")).union(edges.select("b", "b").distinct())
        mark = now


def _alike(x: str, y: str, percent: int) -> Column:
    """Whether sizes and sketches allow a link."""
    bits = F.bit_count(F.col(f"{x}.s0").bitwiseXOR(F.col(f"{y}.s0"))) + F.bit_count(F.col(f"{x}.s1").bitwiseXOR(F.col(f"{y}.s1")))
    apart = (100 - percent) / 200
    most = 128 * apart + DEVIATIONS * (128 * apart * (1 - apart)) ** 0.5
    return (100 * F.least(f"{x}.n", f"{y}.n") >= percent * F.greatest(f"{x}.n", f"{y}.n")) & (bits <= int(most) + 1)


def _in_order(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def near_duplicates(df: DataFrame, percent: int = 85, size: int = 3) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``: links join sets of 100 * intersection >= percent * union.

    Nulls and texts without words have no set and stand alone. Equal sets are
    one item, so copies cost a row each. Null ids are members of their group but
    never its component_id, and rows that share an id are told apart by their
    sets. ``kept`` marks the rows whose id is their component's. Long texts are
    shingled whole; extra columns aren't read; an empty table gives an empty one.
    """
    with scratch(df.sparkSession):
        return stored(_grouped(df, percent, size), result=True)


def _grouped(df: DataFrame, percent: int, size: int) -> DataFrame:
    docs = stored(described(df, size))
    # One text of each item stands for it: that of the least id, and of the least hash under an id.
    of_text = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t")).alias("r")
    items = docs.where("item IS NOT NULL").groupBy("item").agg(F.min("doc_id").alias("first"), of_text, *[F.first(c).alias(c) for c in ("n", "bands", "s0", "s1")])
    items = stored(items.select("item", "first", F.col("r.doc_id").alias("from_id"), F.col("r.t").alias("from_text"), "n", "bands", "s0", "s1", F.xxhash64("item").alias("key")))
    brief = items.select("item", "key", "n", "s0", "s1")

    # A bucket's centre is its member of the least key. Rows of buckets are narrow; what they need of an item is joined to distinct pairs.
    buckets = items.select(F.explode("bands").alias("bucket"), "item", "key")
    centres = stored(buckets.groupBy("bucket").agg(F.min("key").alias("centre"), F.count("*").alias("size")).where("size > 1").drop("size"))
    shared = stored(buckets.join(centres, "bucket").select("bucket", "item", "key", "centre"))
    near = shared.where("key <> centre").select("item", "centre").distinct().join(brief, "item").alias("x")
    pairs = stored(near.join(brief.alias("y"), (F.col("x.centre") == F.col("y.key")) & _alike("x", "y", percent)).select(F.col("x.item").alias("a"), F.col("y.item").alias("b")))
    links = _confirmed(_elements(df, items, _ends(pairs), size), pairs, percent)
    labels = components(links)

    # Buckets that still hold several components. A crowd is gathered around the largest component of its buckets.
    held = stored(shared.join(labels, "item", "left").select("bucket", "item", F.coalesce("label", "item").alias("label")))
    mixed = held.groupBy("bucket", "label").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.max(F.struct("k", "label")).alias("top"), F.count("*").alias("labels"), F.sum("k").alias("held")).where("labels > 1").select("bucket", F.col("top.label").alias("largest"), "held")
    held = stored(held.join(mixed, "bucket"))
    few = held.where(F.col("held") <= FEW).join(brief.drop("key"), "item")
    once = (F.col("y.label") == F.col("y.largest")) | (F.col("x.item") < F.col("y.item"))
    rest = few.where("label <> largest").alias("x").join(few.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.label") != F.col("y.label")) & once & _alike("x", "y", percent))
    rest = stored(_in_order(rest.select(F.col("x.item").alias("a"), F.col("y.item").alias("b"))).distinct().join(_in_order(pairs), ["a", "b"], "left_anti"))
    crowds = stored(held.where(F.col("held") > FEW).select(F.col("largest").alias("centre"), "item", "label").distinct())

    elements = _elements(df, items, _ends(rest).union(crowds.select("item")).distinct(), size)
    certain, more = (pairs.limit(0), pairs.limit(0)) if crowds.isEmpty() else _crowded(crowds, elements, brief, percent)
    tried = _in_order(pairs).union(rest)
    found = _confirmed(elements, stored(rest.union(more.join(tried, ["a", "b"], "left_anti"))), percent).union(certain)

    # The links found last join whole components.
    of = lambda end, name: labels.select(F.col("item").alias(end), F.col("label").alias(name))
    between = found.join(of("a", "la"), "a", "left").join(of("b", "lb"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    joined = components(between).select(F.col("item").alias("label"), F.col("label").alias("over"))
    all_labels = items.select("item", "first").join(labels, "item", "left").select("item", "first", F.coalesce("label", "item").alias("label"))
    all_labels = stored(all_labels.join(joined, "label", "left").select("item", "first", F.coalesce("over", "label").alias("label")))
    least = all_labels.groupBy("label").agg(F.min("first").alias("low"), F.count("*").alias("k")).where("k > 1").drop("k")
    of_item = all_labels.join(least, "label", "left").select("item", F.coalesce("low", "first").alias("component_id"))
    out = docs.select("doc_id", "n", "item").join(of_item, "item", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("item").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("item")).union(pairs.select("b")).distinct()


def _elements(df: DataFrame, items: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``(item, elements)`` of the wanted items, from the text that stands for each; the text's hash keeps rows without an id apart."""
    importable(df.sparkSession)
    wanted = wanted.join(items.select("item", "from_id", "from_text"), "item")
    texts = df.select("doc_id", F.xxhash64("text").alias("t"), "text").join(wanted, (F.col("t") == F.col("from_text")) & F.col("doc_id").eqNullSafe(F.col("from_id"))).select("text", "item")
    return stored(_sets(texts, size))


def _confirmed(elements: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    a = elements.select(F.col("item").alias("a"), F.col("elements").alias("of_a"))
    b = elements.select(F.col("item").alias("b"), F.col("elements").alias("of_b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("both"), F.size("of_a").alias("na"), F.size("of_b").alias("nb"))
    return stored(both.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b"))


def _by_crowd(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` with the facts of their crowd; the rows of a large crowd are dealt out."""
    split = facts.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.withColumn("salt", F.pmod(F.hash("item"), F.lit(SALTS))).join(split, ["centre", "salt"], "left").drop("salt")


def _crowded(crowds: DataFrame, elements: DataFrame, brief: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links and further candidates (a, b) between the components of each crowd, by the items' differences from its majority set.

    A crowd's majority set has at most twice as many elements as an item has on
    average, and at most 100 times as many differences as an item has on average
    are common (those of over one in a hundred items); both go to their crowd's rows.
    """
    more, none = 100 + percent, F.array().cast("array<long>")
    sized = _by_crowd(crowds, crowds.groupBy("centre").agg(F.count("*").alias("crowd")))
    rows = sized.join(elements, "item").join(brief.drop("key"), "item")
    majority = rows.select("centre", "crowd", F.explode("elements").alias("e")).groupBy("centre", "e").agg(F.count("*").alias("f"), F.first("crowd").alias("crowd")).where("2 * f > crowd").groupBy("centre").agg(F.collect_list("e").alias("common"))
    common = F.coalesce("common", none)
    delta = F.concat(F.array_except("elements", common), F.array_except(common, F.col("elements")))
    rows = _by_crowd(rows, majority).select("centre", "item", "label", "crowd", "n", "s0", "s1", delta.alias("delta"))
    rows = stored(rows.withColumn("excess", more * F.size("delta") - (100 - percent) * F.col("n")))

    best = rows.groupBy("centre").agg(F.min(F.struct("excess", "item", "label")).alias("best"))
    rows = _by_crowd(rows, best).withColumn("outer", F.col("excess") + F.col("best.excess") > 0)
    frequent = rows.select("centre", "crowd", F.explode("delta").alias("e")).groupBy("centre", "e").agg(F.count("*").alias("f"), F.first("crowd").alias("crowd")).where("100 * f > crowd").groupBy("centre").agg(F.array_sort(F.collect_list(F.struct("f", "e")))["e"].alias("frequent"))
    facts = rows.where("outer").groupBy("centre").agg(F.min("excess").alias("least_outer")).join(frequent, "centre", "left")
    certain = rows.where(~F.col("outer") & (F.col("label") != F.col("best.label"))).select(F.col("item").alias("a"), F.col("best.item").alias("b"))

    # Rare differences first; an item's prefix leaves out one less than it must have in common with any partner.
    frequent = F.coalesce("frequent", none)
    ordered = F.concat(F.array_sort(F.array_except("delta", frequent)), F.array_intersect(frequent, F.col("delta")))
    needed = lambda least: F.ceil((F.col("excess") + least) / (2 * more)).cast("int")
    rows = stored(_by_crowd(rows, facts).where("least_outer IS NOT NULL").withColumn("delta", ordered))

    def prefixes(of: DataFrame, least: Column) -> DataFrame:
        size = F.size("delta")
        start = F.slice("delta", F.lit(1), F.greatest(size - needed(least) + 1, F.lit(0)))
        return of.select("centre", "item", "label", "outer", "excess", "n", "s0", "s1", size.alias("size"), F.posexplode(start).alias("at", "e"))

    x, y = prefixes(rows.where("outer"), F.col("best.excess")).alias("x"), prefixes(rows, F.col("least_outer")).alias("y")
    left = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))  # a pair's first common difference is one of so many at most
    on = (F.col("x.centre") == F.col("y.centre")) & (F.col("x.e") == F.col("y.e")) & (F.col("x.label") != F.col("y.label")) & (~F.col("y.outer") | (F.col("x.item") < F.col("y.item")))
    met = x.join(y, on & (2 * more * left >= F.col("x.excess") + F.col("y.excess")) & _alike("x", "y", percent))
    return certain, _in_order(met.select(F.col("x.item").alias("a"), F.col("y.item").alias("b"))).distinct()


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS x FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l
), r AS (
  SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id
), c AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
