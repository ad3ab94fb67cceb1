"""A corpus pipeline of five of the training-data operators, each stage over all that the one before kept.

Every row is a document of its own: the first stage gives it a number, and the
decisions of an operator come back to the row by that, never by a doc_id that may
be null or shared. A stage's result is to be written before the next stage is
called, which removes what the stage had stored on its way.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import ExitStack
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.llm import bpe, decontam, langid, minhash, suffix
from hushlake.llm.common import scratch, stored, table
from hushlake.llm.queries import PATTERN, RANKS

#: The column with the number of a row.
ROW = "corpus_row"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_before = ExitStack()


def _stage(work: Stage) -> Stage:
    """A stage that first removes the tables and shuffles of the one before."""

    @wraps(work)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _before.close()
        if work is not STAGES[-1][1].__wrapped__:
            _before.enter_context(scratch(spark))
        return work(spark, docs, sf_dir)

    return call


#: Characters of a text by which rows of one id are dealt to partitions: the bounds of partitions are chosen on the driver, from a sample of these keys.
KEY = 64


def _in_order(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row in the order of the ids, null last; rows of one id are in the order of their texts, then of their other columns.

    Partitions are ranges of the id and the start of the text, and are sorted by
    all of the row, which is the same order.
    """
    by_id = F.col("doc_id").asc_nulls_last()
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.repartitionByRange(by_id, F.substring("text", 1, KEY)).sortWithinPartitions(by_id, F.col("text"), *rest).withColumn(ROW, F.monotonically_increasing_id())


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` if its rows have numbers, else with numbers and stored, so that they stay."""
    return docs if ROW in docs.columns else stored(_in_order(docs))


def _by_row(rows: DataFrame) -> DataFrame:
    """What the operators read, with the number as the id."""
    return rows.select(F.col(ROW).alias("doc_id"), "text")


@_stage
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier doesn't reject.

    Nulls and texts without a letter are rejected, repeated rows alike; an empty
    table stays empty. Columns named like a prediction stay as they are.
    """
    rows = docs if ROW in docs.columns else _in_order(docs)
    return rows.where(~langid.predictor(spark, langid.train(docs))(F.col("text"))["rejected"])


@_stage
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group of near-duplicates (five words a shingle, similarity 0.8).

    Repeated rows are a group; nulls and texts without words are in none, and stay.
    """
    rows = numbered(docs)
    kept = minhash.near_duplicates(_by_row(rows), percent=80, size=5).where("kept").select(F.col("doc_id").alias("kept_row"))
    return rows.join(kept, rows[ROW] == kept["kept_row"], "left_semi")


@_stage
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that an earlier document has; a character that loses a byte goes as a whole, and so does a text that loses all.

    The other columns travel with the texts, so nothing is joined back. Null and
    empty texts lose nothing and stay as they are; ``n_chars``, where there is
    one, is counted anew for texts that lost something.
    """
    rows = numbered(docs)
    # Ids of the rows and all their columns, each by its place: names can't clash.
    sent = rows.select(F.col(ROW).alias("doc_id"), "text", F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rows.columns) if c != "text"], F.col("text").isNull().alias("none")).alias("rest"))
    done = suffix.remove_repeats(sent, "text", ["rest"])
    cut = F.col("n_removed") > 0
    out = done.where(~cut | (F.length("kept") > 0))
    text = F.when(~F.col("row.rest.none"), F.col("kept"))
    kind = {f.name: f.dataType for f in rows.schema.fields}
    of = lambda k, c: text if c == "text" else F.when(cut, F.length("kept").cast(kind[c])).otherwise(F.col(f"row.rest.c{k}")) if c == "n_chars" else F.col(f"row.rest.c{k}")
    return out.select(*[of(k, c).alias(c) for k, c in enumerate(rows.columns)])


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Nulls and empty texts hold none; each of repeated rows is judged alike."""
    return decontam.clean(numbered(docs), table(spark, sf_dir, "benchmark"), ROW)


@_stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of their decoded bytes, a row for each document; a null text is empty."""
    return bpe.encode_documents(docs, RANKS, PATTERN, digests_only=True)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", known_language),
    ("MinHash near-dedup", one_of_each_group),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE encoding and decoding", encoded),
]

#: The language classifier, the edge effects of substring removal and tokenization can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), result=True)
    return STAGES[-1][1](spark, docs, sf_dir)
