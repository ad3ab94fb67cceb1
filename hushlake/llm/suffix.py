"""Suffix-array dedup: repeated byte strings found by a distributed merge sort of suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts in a document
with a smaller id. Each such string (a window) holds exactly one anchor, the least
of its grams by a hash, so equal windows have equal anchors at equal offsets, and
only the suffixes that start at anchors are sorted (about one in 16 bytes):

1. Texts are laid into runs of some megabytes, stored once, by run in buckets.
2. Runs exchange the hashes of their anchors' grams; only grams of two or more
   documents go on. A run sends each gram once, however many documents hold it.
3. Runs sort the suffixes at those anchors, front-code them (length of the prefix
   common with the one before, and the rest) and exchange them by gram. Each task
   merges its runs by a loser tree that compares from the known common prefix
   on, and gets the common-prefix array of the merged order with it.
4. Windows that reach r bytes right of their anchor are equal there if they lie in
   one interval of that array of depth r; with the bytes left of the anchor this
   gives, for each window, the least document that has it.
5. Answers go back to the runs, which mark bytes and return the rest of each text.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructField, StructType

from hushlake.llm.common import importable, on_release, shared_dir, shuffle_parts

LENGTH, GRAM = 50, 20
REACH = LENGTH - GRAM + 1
RUN_BYTES = 1 << 21
#: Suffixes or grams of a task, about.
PER_TASK = 400_000
NOBODY = np.iinfo(np.int64).max
_M = 0x9E3779B97F4A7C15
_WIDTH = LENGTH + REACH - 1 + 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


#: Windows whose anchors are sought at a time; a long text takes no more work space than this.
AT_ONCE = 1 << 20


def _least_grams(data: np.ndarray) -> np.ndarray:
    """Place of the anchor of each window of the data."""
    n = len(data)
    h, width, four = data.astype(np.uint64) + np.uint64(1), 1, None
    while width < 16:
        h = h[:-width] * np.uint64(pow(_M, width, 1 << 64)) + h[width:]
        width *= 2
        four = h if width == 4 else four
    h = h[: n - GRAM + 1] * np.uint64(pow(_M, 4, 1 << 64)) + four[16 : 16 + n - GRAM + 1]
    key = (_mix(h) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width < 16:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    key = np.minimum(key[: n - LENGTH + 1], key[REACH - 16 : REACH - 16 + n - LENGTH + 1])
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def anchors(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, and the least and the largest offset of an anchor in its windows."""
    n = len(data)
    inside = np.zeros(n + 1, np.int8)
    long = sizes >= LENGTH
    inside[starts[long]] += 1
    inside[(starts + sizes - LENGTH + 1)[long]] -= 1
    inside = np.cumsum(inside, dtype=np.int8)
    parts = []
    for begin in range(0, max(0, n - LENGTH + 1), AT_ONCE):
        end = min(begin + AT_ONCE, n - LENGTH + 1)
        window = np.flatnonzero(inside[begin:end])
        if len(window):
            at = _least_grams(data[begin : end + LENGTH - 1])[window]
            first = np.flatnonzero(np.diff(at, prepend=-1))
            last = np.append(first[1:], len(at)) - 1
            parts.append((at[first] + begin, at[first] - window[last], at[first] - window[first]))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.uint8), np.empty(0, np.uint8)
    at, low, high = (np.concatenate(p) for p in zip(*parts, strict=True))
    again = np.flatnonzero(np.diff(at) == 0)  # an anchor of windows on both sides of a border
    low[again] = low[again + 1]
    keep = np.delete(np.arange(len(at)), again + 1)
    return at[keep], low[keep].astype(np.uint8), high[keep].astype(np.uint8)


class Run:
    """A row of the table of runs."""

    def __init__(self, row) -> None:
        self.data = np.frombuffer(row.text, np.uint8)
        self.ids, self.sizes = np.frombuffer(row.ids, np.int64), np.frombuffer(row.sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.at, self.low, self.high = np.frombuffer(row.at, np.int32).astype(np.int64), np.frombuffer(row.low, np.uint8), np.frombuffer(row.high, np.uint8)
        self.doc = self.ids[np.searchsorted(self.starts, self.at, "right") - 1] if len(self.at) else np.empty(0, np.int64)

    def grams(self) -> np.ndarray:
        """Hash of the gram at each anchor."""
        part = np.lib.stride_tricks.sliding_window_view(self.data, GRAM)[self.at] if len(self.at) else np.empty((0, GRAM), np.uint8)
        words = np.ascontiguousarray(part).view(np.uint32).astype(np.uint64)
        h = np.full(len(words), 1, np.uint64)
        for k in range(GRAM // 4):
            h = _mix(h * np.uint64(_M) + words[:, k])
        return h

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct grams, whether several of the run's documents have each, and each anchor's place among them."""
        found, inverse = np.unique(self.grams(), return_inverse=True)
        low, high = np.full(len(found), NOBODY), np.full(len(found), -NOBODY)
        np.minimum.at(low, inverse, self.doc)
        np.maximum.at(high, inverse, self.doc)
        return found, low < high, inverse

    def suffixes(self, shared: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct sorted entries (suffix, bytes left of it backwards, offsets), their gram, least and largest document; and of which anchors, and which entry each is."""
        use = np.flatnonzero(shared[inverse]) if len(inverse) else np.empty(0, np.int64)
        padded = np.concatenate([np.zeros(REACH - 1, np.uint8), self.data, np.zeros(LENGTH, np.uint8)])
        view = np.lib.stride_tricks.sliding_window_view(padded, LENGTH + REACH - 1)[self.at[use]]
        entry = np.empty((len(use), _WIDTH), np.uint8)
        entry[:, :LENGTH], entry[:, LENGTH:-2] = view[:, REACH - 1 :], view[:, REACH - 2 :: -1]
        entry[:, -2], entry[:, -1] = self.low[use], self.high[use]
        entry[:, :LENGTH][np.arange(LENGTH) >= (LENGTH - self.low[use].astype(np.int64))[:, None]] = 0
        entry[:, LENGTH:-2][np.arange(REACH - 1) >= self.high[use][:, None]] = 0
        rows, first, which = np.unique(entry.view(f"V{_WIDTH}").ravel(), return_index=True, return_inverse=True)
        low, high = np.full(len(rows), NOBODY), np.full(len(rows), -NOBODY)
        np.minimum.at(low, which, self.doc[use])
        np.maximum.at(high, which, self.doc[use])
        return rows.view(np.uint8).reshape(-1, _WIDTH), inverse[use][first] if len(use) else use, np.stack([low, high]), use, which


def runs_of(df: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Rows of (run, ids, sizes, text, at, low, high, carried): documents laid end to end, with their anchors and their other columns. A null id is the largest."""
    others = [f"c{k}" for k in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, parts, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)
            at, low, high = anchors(data, np.cumsum(sizes) - sizes, sizes)
            rest = pa.BufferOutputStream()
            if others:
                rows = pa.Table.from_batches(parts)
                with pa.ipc.new_stream(rest, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_table(rows)
            carried = rest.getvalue().to_pybytes()
            name = hashlib.md5(np.array(ids, np.int64).tobytes() + data.tobytes() + carried).hexdigest()
            values = {"run": f"{name}-{len(ids)}", "ids": np.array(ids, np.int64).tobytes(), "sizes": sizes.tobytes(), "text": data.tobytes(), "at": at.astype(np.int32).tobytes(), "low": low.tobytes(), "high": high.tobytes(), "carried": carried}
            return pa.RecordBatch.from_pydict({k: [v] for k, v in values.items()})

        for batch in batches:
            begin = 0
            for k, (i, t) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                ids.append(NOBODY if i is None else i)
                texts.append((t or "").encode("utf-8", "surrogatepass"))
                held += len(texts[-1]) + 16
                if held >= RUN_BYTES:
                    parts.append(batch.slice(begin, k + 1 - begin).select(others))
                    yield out()
                    ids, texts, parts, held, begin = [], [], [], 0, k + 1
            if begin < batch.num_rows:
                parts.append(batch.slice(begin).select(others))
        if ids:
            yield out()

    read = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(f"`{c}`").alias(o) for c, o in zip(carry, others, strict=True)])
    return read.mapInArrow(run, "run string, ids binary, sizes binary, text binary, at binary, low binary, high binary, carried binary")


def _parts(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def front_code(rows: np.ndarray) -> bytes:
    """Sorted rows as common-prefix lengths and what follows the prefixes."""
    same = rows[1:] == rows[:-1]
    common = np.concatenate([[0], np.where(same.all(axis=1), _WIDTH, np.argmin(same, axis=1))]).astype(np.uint8) if len(rows) else np.empty(0, np.uint8)
    rest = rows[np.arange(_WIDTH) >= common[:, None]]
    return zlib.compress(common.tobytes() + rest.tobytes(), 1)


def front_decode(coded: bytes, n: int) -> tuple[list[bytes], list[int]]:
    """Rows and their common prefixes with the row before."""
    raw = zlib.decompress(coded)
    common, at, rows, row = list(raw[:n]), n, [], b""
    for c in common:
        end = at + _WIDTH - c
        row = row[:c] + raw[at:end]
        rows.append(row)
        at = end
    return rows, common


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs of equally long rows by a loser tree: (run, place in it, common prefix with the row before) in order.

    Each contender knows its common prefix with the last winner. The longer one
    wins without a comparison; only of equal ones are bytes compared, from there
    on, and the loser keeps what they have in common.
    """
    k = 1
    while k < len(runs):
        k *= 2
    end = bytes()
    heads = [(r[0][0] if r[0] else end) for r in runs] + [end] * (k - len(runs))
    known, place = [0] * k, [0] * k
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; an exhausted run loses."""
        s, t = heads[a], heads[b]
        if not t:
            return a, b
        if not s:
            return b, a
        c, d = known[a], known[b]
        if c != d:
            return (a, b) if c > d else (b, a)
        if s[c:] == t[c:]:
            first, second = (a, b) if a < b else (b, a)
            known[second] = _WIDTH
            return first, second
        while s[c] == t[c]:
            c += 1
        if s[c] < t[c]:
            known[b] = c
            return a, b
        known[a] = c
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        won, lost = play(build(2 * node), build(2 * node + 1))
        losers[node] = lost
        return won

    winner = build(1)
    of, at, common = [], [], []
    while heads[winner]:
        of.append(winner)
        at.append(place[winner])
        common.append(known[winner])
        rows, own = runs[winner]
        place[winner] = nxt = place[winner] + 1
        if nxt < len(rows):
            heads[winner], known[winner] = rows[nxt], own[nxt]
        else:
            heads[winner] = end
        node = winner + k >> 1
        while node:
            winner, losers[node] = play(winner, losers[node])
            node >>= 1
    return of, at, common


def least_documents(rows: np.ndarray, common: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For merged entries: (entry, first offset, last offset, least document of the windows at these offsets), where it is less than some document of the entry."""
    n = len(rows)
    # Bytes left of the anchors, sorted: those that agree in o bytes are neighbours there.
    left = np.ascontiguousarray(rows[:, LENGTH : LENGTH + REACH - 1])
    by_left = np.argsort(left.view(f"V{REACH - 1}").ravel(), kind="stable")
    same = left[by_left[1:]] == left[by_left[:-1]]
    agree = np.where(same.all(axis=1), REACH, np.argmin(same, axis=1))
    kept, since, out = np.full(n, NOBODY), np.zeros(n, np.int64), []
    for o in range(REACH + 1):
        now = np.full(n, NOBODY)
        if o < REACH:
            on = np.flatnonzero((rows[:, -2] <= o) & (rows[:, -1] >= o))
            if len(on):
                side = np.empty(n, np.int64)
                side[by_left] = np.cumsum(np.concatenate([[0], agree < o]))
                interval = np.cumsum(common < LENGTH - o)
                _, inverse = np.unique(interval[on] * n + side[on], return_inverse=True)
                least = np.full(inverse.max() + 1, NOBODY)
                np.minimum.at(least, inverse, low[on])
                now[on] = np.where(least[inverse] < high[on], least[inverse], NOBODY)
        change = np.flatnonzero(now != kept)
        done = change[kept[change] != NOBODY]
        out.append((done, since[done], np.full(len(done), o - 1), kept[done]))
        kept[change], since[change] = now[change], o
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


#: How the rest of a text is returned: column, type, and how it is made. As text, a character that lost a byte goes as a whole.
FORMS = {"bytes": ("kept", "binary", bytes), "text": ("kept", "string", lambda b: b.decode("utf-8", "ignore")), "sha256": ("kept_sha256", "string", lambda b: hashlib.sha256(b).hexdigest())}


def remove_repeats(df: DataFrame, form: str = "bytes", carry: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)``: what is left of each text in one of FORMS, a row for each input row.

    Nulls and empty texts have no bytes; a null id is larger than any other and
    rows that share an id don't count against each other, so of repeated rows
    none loses anything to another. Strings are judged on the input. Ids must be
    integers, as their order decides. A text of any length is one row; extra
    columns aren't read, but for those of ``carry``, which come back in a struct
    ``row``. An empty table gives an empty one. The table of runs goes with the
    scratch block around the call.
    """
    spark = df.sparkSession
    if not isinstance(df.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be an integer")
    importable(spark)
    parts = shuffle_parts(spark)
    name = f"hushlake_runs_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    runs_of(df, carry).write.bucketBy(parts, "run").option("compression", "zstd").option("path", path).saveAsTable(name)
    on_release(spark, path, lambda: spark.sql(f"DROP TABLE IF EXISTS {name}"))
    runs = spark.table(name)
    size = runs.agg(F.sum(F.octet_length("at"))).first()[0] or 0
    tasks = max(parts, size // 4 // PER_TASK + 1)

    def send_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                keys, several, _ = Run(row).keys()
                cut = np.searchsorted(_parts(keys, tasks), np.arange(tasks + 1))
                some = [t for t in range(tasks) if cut[t] < cut[t + 1]]
                yield pd.DataFrame({"part": some, "run": row.run, "keys": [keys[cut[t] : cut[t + 1]].tobytes() for t in some], "several": [np.packbits(several[cut[t] : cut[t + 1]]).tobytes() for t in some]})

    def match_keys(group: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(k, np.uint64) for k in group["keys"]]
        sizes = [len(k) for k in keys]
        several = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=n) for s, n in zip(group["several"], sizes, strict=True)])
        found, inverse, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        shared = count > 1
        shared[inverse[several > 0]] = True
        split = np.split(shared[inverse], np.cumsum(sizes)[:-1])
        return pd.DataFrame({"part": group["part"], "run": group["run"], "n": sizes, "shared": [np.packbits(s).tobytes() for s in split]})

    needed = ("run", "ids", "sizes", "text", "at", "low", "high")
    sent = runs.select(*needed).mapInPandas(send_keys, "part int, run string, keys binary, several binary")
    matched = sent.groupBy("part").applyInPandas(match_keys, "part int, run string, n int, shared binary")
    bits = matched.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("part", "n", "shared"))).alias("shared"))

    def flags(row) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint8), *[np.unpackbits(np.frombuffer(s["shared"], np.uint8), count=s["n"]) for s in (row.shared if row.shared is not None else [])]]).astype(bool)

    def entries(row) -> tuple:
        run = Run(row)
        keys, _, inverse = run.keys()
        rows, gram, docs, use, which = run.suffixes(flags(row), inverse)
        part = _parts(keys[gram], tasks) if len(gram) else np.empty(0, np.int64)
        return run, rows, docs, part, use, which

    def send_suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                _, rows, docs, part, _, _ = entries(row)
                order = np.argsort(part, kind="stable")
                cut = np.searchsorted(part[order], np.arange(tasks + 1))
                out = [(t, row.run, int(cut[t + 1] - cut[t]), front_code(rows[mine := order[cut[t] : cut[t + 1]]]), zlib.compress(docs[:, mine].tobytes(), 1)) for t in range(tasks) if cut[t] < cut[t + 1]]
                yield pd.DataFrame(out, columns=["part", "run", "n", "coded", "docs"])

    def merge_suffixes(group: pd.DataFrame) -> pd.DataFrame:
        sorted_runs = [front_decode(c, n) for c, n in zip(group["coded"], group["n"], strict=True)]
        of, at, common = merge(sorted_runs)
        docs = [np.frombuffer(zlib.decompress(d), np.int64).reshape(2, -1) for d in group["docs"]]
        first = np.cumsum([0, *group["n"]])
        rows = np.frombuffer(b"".join([sorted_runs[r][0][i] for r, i in zip(of, at, strict=True)]), np.uint8).reshape(-1, _WIDTH)
        source = np.array(of), np.array(at)
        where = first[source[0]] + source[1]
        low, high = np.concatenate(docs, axis=1)[:, where]
        entry, begin, end, least = least_documents(rows, np.array(common), low, high)
        run, place = source[0][entry], source[1][entry]
        order = np.argsort(run, kind="stable")
        cut = np.searchsorted(run[order], np.arange(len(group) + 1))
        out = [(int(group["part"].iloc[0]), group["run"].iloc[k], zlib.compress(np.stack([place[s], begin[s], end[s], least[s]]).astype(np.int64).tobytes(), 1)) for k in range(len(group)) if len(s := order[cut[k] : cut[k + 1]])]
        return pd.DataFrame(out, columns=["part", "run", "answers"])

    with_bits = runs.join(bits.hint("shuffle_hash"), "run", "left")
    suffixes = with_bits.drop("carried").mapInPandas(send_suffixes, "part int, run string, n int, coded binary, docs binary")
    answers = suffixes.groupBy("part").applyInPandas(merge_suffixes, "part int, run string, answers binary")
    answers = answers.groupBy("run").agg(F.collect_list(F.struct("part", "answers")).alias("answers"))
    last, kind, made = FORMS[form]
    row_type = StructType([StructField(c, df.schema[c].dataType) for c in carry])

    def removed(row) -> np.ndarray:
        """Which bytes of a run go."""
        run = Run(row)
        gone = np.zeros(len(run.data) + 1, np.int32)
        if row.answers is not None and len(row.answers):
            run, rows, docs, part, use, which = entries(row)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(tasks + 1))
            got = [np.concatenate([order[cut[a["part"]] + (m := np.frombuffer(zlib.decompress(a["answers"]), np.int64).reshape(4, -1))[0]][None], m[1:]]) for a in row.answers]
            entry, begin, end, least = np.concatenate(got, axis=1)
            by_entry = np.argsort(which, kind="stable")
            count = np.bincount(which, minlength=len(rows))
            start = np.cumsum(count) - count
            times = count[entry]
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            anchor = use[by_entry[np.repeat(start[entry], times) + step]]
            hit = np.repeat(least, times) < run.doc[anchor]
            where, b, e = run.at[anchor[hit]], np.repeat(begin, times)[hit], np.repeat(end, times)[hit]
            np.add.at(gone, where - e, 1)
            np.add.at(gone, where - b + LENGTH, -1)
        return np.cumsum(gone[:-1]) > 0

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                run, mask, out = Run(row), removed(row), []
                for i, s, n in zip(run.ids.tolist(), run.starts.tolist(), run.sizes.tolist(), strict=True):
                    m = mask[s : s + n]
                    spans = int(m[:1].sum()) + int((m[1:] & ~m[:-1]).sum())
                    out.append((None if i == NOBODY else i, n, int(m.sum()), spans, made(run.data[s : s + n][~m].tobytes())))
                frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", last])
                frame["doc_id"] = pd.array([o[0] for o in out], "Int64")
                yield frame

    def apply_and_carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas()
            for k, frame in enumerate(apply(rows.iloc[j : j + 1] for j in range(len(rows)))):
                out = pa.RecordBatch.from_pandas(frame, preserve_index=False)
                carried = pa.ipc.open_stream(rows["carried"].iloc[k]).read_all().combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*out.columns, pa.StructArray.from_arrays(carried.columns, row_type.names)], [*out.schema.names, "row"])

    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, {last} {kind}"
    answered = with_bits.join(answers.hint("shuffle_hash"), "run", "left")
    if not carry:
        return answered.drop("carried").mapInPandas(apply, schema)
    return answered.mapInArrow(apply_and_carry, f"{schema}, row {row_type.simpleString()}")
