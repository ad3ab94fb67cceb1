"""Tokens restored in a stream of chunks, also where a chunk ends inside one."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hushlake.operators.scan import importable

#: Characters of an open bracket that are kept back, or more if the mapping has a longer token.
LONGEST = 64
_TOKEN = re.compile(r"\[[^\[\]]*\]")


class Restorer:
    """Feeds on chunks of one stream; keeps an open bracket back until it closes, as far as a token of the mapping may reach."""

    def __init__(self, known: dict[str, str], pending: str = "") -> None:
        self.known, self.pending = known, pending
        self.longest = max([LONGEST, *map(len, known)])

    def feed(self, chunk: str) -> str:
        text = self.pending + chunk
        at = text.rfind("[")
        keep = at >= 0 and "]" not in text[at:] and len(text) - at < self.longest
        self.pending = text[at:] if keep else ""
        return _TOKEN.sub(lambda m: self.known.get(m[0], m[0]), text[:at] if keep else text)

    def flush(self) -> str:
        out, self.pending = self.pending, ""
        return out


def restore_stream(chunks: DataFrame, known: dict[str, str]) -> DataFrame:
    """``(stream_id, seq, text)`` for a streaming frame (stream_id, seq, chunk, last).

    The state of a stream is its open bracket, no longer than the longest token. Chunks of a
    stream that arrive together go by seq; the mapping is the session's, at most
    10,000 entries. A chunk marked ``last`` flushes and drops the state.
    """
    importable(chunks.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        r = Restorer(known, state.get[0] if state.exists else "")
        rows = pd.concat(list(frames)).sort_values("seq")
        out, ended = [], False
        for seq, chunk, last in zip(rows["seq"], rows["chunk"], rows["last"], strict=True):
            out.append((key[0], seq, r.feed(chunk) + (r.flush() if last else "")))
            ended = bool(last)
        if ended:
            state.remove()
        else:
            state.update((r.pending,))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "text"])

    return chunks.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, seq long, text string", "pending string", "append", GroupStateTimeout.NoTimeout)
