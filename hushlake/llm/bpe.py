"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are pre-split where no match of the pattern can span: between a
character that is not white space and one that is. Each token of the pattern
holds white space only at its start (or is all white space), so these cuts fall
on token borders, and a text is encoded in bounded pieces.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlake.llm.common import importable

#: Characters of a text that are encoded at a time.
PIECE = 1 << 16
_SAFE = re.compile(r"(?<=\S)(?=\s)")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _decimals(n: int) -> list[str]:
    return [str(i) for i in range(n)]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cut ``text`` at the first safe boundary after every ``size`` characters; a text without one stays whole."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str | None, rank_file: str, pattern: str) -> list[int]:
    """Ids of a text; a null is the empty text."""
    enc, ids = encoding(rank_file, pattern), []
    for piece in pieces(text or ""):
        ids += enc.encode_ordinary(piece)
    return ids


def decode(ids: list[int], rank_file: str, pattern: str) -> bytes:
    """The raw bytes of ids, also where they aren't whole characters."""
    return encoding(rank_file, pattern).decode_bytes(ids)


def encode_documents(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False) -> DataFrame:
    """One row for each input row: ``(doc_id, n_tokens, ids, decoded)``, or digests of the last two.

    A null text counts as empty: no ids, empty bytes. A null id is passed on.
    Repeated rows each have their row; an empty table gives an empty one. Other
    columns of the input are not read.
    """
    importable(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    out = "ids_sha256 string, decoded_sha256 string" if digests_only else "ids array<int>, decoded binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sha = lambda b: hashlib.sha256(b).hexdigest()
        names = _decimals(1 + max(encoding(rank_file, pattern)._mergeable_ranks.values(), default=0))
        for batch in batches:
            done: dict[str, tuple] = {}
            for text in batch["text"]:
                text = text or ""
                if text in done:
                    continue
                ids = encode(text, rank_file, pattern)
                raw = decode(ids, rank_file, pattern)
                done[text] = (len(ids), sha(" ".join([names[i] for i in ids]).encode()), sha(raw)) if digests_only else (len(ids), ids, raw)
            rows = [done[t or ""] for t in batch["text"]]
            a, b = ("ids_sha256", "decoded_sha256") if digests_only else ("ids", "decoded")
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [r[0] for r in rows], a: [r[1] for r in rows], b: [r[2] for r in rows]})

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id {kind}, n_tokens long, {out}")
