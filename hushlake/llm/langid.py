"""Language identification: averaged hashed subword embeddings under a linear softmax.

Text is lower-cased, every character that is no letter becomes a space, and the
UTF-8 bytes of each window of 2, 3 and 4 characters are hashed to a bucket with an
embedding; a text is the average of its windows' embeddings, and a linear
softmax over that gives the language. Both layers are trained together by
stochastic gradient descent in numpy. A temperature fitted on rows kept aside
turns the softmax into a calibrated score, and the rejection threshold is the
low quantile of that score on the same rows.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from hushlake.llm.common import importable

#: Rows of each language that the model is fitted on, and of all of them (expected numbers; which rows is a matter of a hash). One task on an executor gets two sparse vectors of at most BUCKETS numbers for each, the driver gets the model alone.
ROWS_PER_LANGUAGE, ROWS_IN_ALL = 700, 20_000
BUCKETS, DIM = 1 << 13, 16
#: Rejects the share of known rows with the lowest scores, and everything without a letter.
REJECTED_SHARE = 0.001
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def _codes(text: str) -> np.ndarray:
    """Code points of the folded text with one space at each end."""
    folded = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, folded)):
        folded = ""
    return np.frombuffer(f" {folded} ".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) if folded else np.empty(0, np.uint64)


def _buckets(codes: np.ndarray) -> np.ndarray:
    """Bucket of each window of 2, 3 and 4 characters."""
    out, h = [], codes
    for k in (1, 2, 3):
        if len(codes) <= k:
            break
        h = h[: len(codes) - k] * np.uint64(0x9E3779B97F4A7C15) + codes[k:] + np.uint64(k)
        out.append(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(51)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


Sparse = tuple[np.ndarray, np.ndarray]


def features(text: str) -> Sparse:
    """Buckets that the text's windows fall in, and the share of the windows in each."""
    counts = np.bincount(_buckets(_codes(text)), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, (counts[at] / max(1, counts.sum())).astype(np.float32)


def _snippet(text: str) -> str:
    """A run of 1 to 30 of the text's words, picked by a hash of the text, so that short texts are known as well."""
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    words = text.split()
    n = int(rng.integers(1, 31))
    at = int(rng.integers(0, max(1, len(words) - n)))
    return " ".join(words[at : at + n])


def _dense(rows: list[Sparse]) -> np.ndarray:
    out = np.zeros((len(rows), BUCKETS), np.float32)
    for k, (at, share) in enumerate(rows):
        out[k, at] = share
    return out


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # (BUCKETS, languages): embeddings times the linear layer, divided by the temperature
    bias: np.ndarray
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated score; UNKNOWN and 0 for null, for texts without a letter, and for a model of no language."""
        codes = _codes(text or "")
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        found = _buckets(codes)
        counts = np.bincount(found, minlength=BUCKETS)
        z = counts @ self.logits / max(1, len(found)) + self.bias
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], langs: list[str], **how) -> Model:
    """Train on labelled texts. Texts without a letter teach nothing."""
    known = [(t, l) for t, l in zip(texts, langs, strict=True) if l is not None and len(_codes(t or ""))]
    return fit_vectors([(features(t), features(_snippet(t))) for t, _ in known], [l for _, l in known], **how)


def fit_vectors(rows: list[tuple[Sparse, Sparse]], langs: list[str], epochs: int = 30, rate: float = 8.0, seed: int = 7) -> Model:
    """Train on the vectors of each text and of its snippet; a fifth of the texts calibrates."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 0.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    of = {l: k for k, l in enumerate(names)}
    labels = np.array([of[l] for l in langs])
    held, train = order[: len(rows) // 5], order[len(rows) // 5 :]
    x, y = [v for k in train for v in rows[k]], np.repeat(labels[train], 2)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w = rng.normal(0, 0.1, (DIM, len(names))).astype(np.float32)
    b = np.zeros(len(names), np.float32)
    weight = (len(y) / (len(names) * np.maximum(1, np.bincount(y, minlength=len(names))))).astype(np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            xb, yb = _dense([x[k] for k in at]), y[at]
            hidden = xb @ emb
            g = _softmax(hidden @ w + b)
            g[np.arange(len(yb)), yb] -= 1
            g *= weight[yb][:, None] / len(yb)
            back = xb.T @ (g @ w.T)
            w -= step * 0.1 * (hidden.T @ g)
            b -= step * 0.01 * g.sum(axis=0)
            emb -= step * 4 * back
    flat = emb @ w
    if len(held):
        x, y = [v for k in held for v in rows[k]], np.repeat(labels[held], 2)
    z = np.array([share @ flat[at] for at, share in x]) + b
    loss = lambda t: -np.log(np.maximum(1e-12, _softmax(z / t)[np.arange(len(y)), y])).mean()
    temperature = min(np.geomspace(0.05, 20, 60), key=loss)
    top = _softmax(z[::2] / temperature).max(axis=1)  # of whole texts
    return Model(names, (flat / temperature).astype(np.float64), (b / temperature).astype(np.float64), float(np.quantile(top, REJECTED_SHARE)))


def held_out(id_col: str = "doc_id"):
    """Rows that no model learns from: the remainder of crc32 of the id as text by 3 is 1. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(df: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Fit on about ``rows_per_language`` whole texts of each language, chosen by a hash of the row among those not held out; repeated rows count once."""
    importable(df.sparkSession)
    known = df.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], [])
    wanted = min(rows_per_language, ROWS_IN_ALL / len(counts))
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, wanted / n))])
    chosen = known.select("lang", "text", F.xxhash64("doc_id", "lang", "text").alias("h")).where(F.pmod("h", F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003).dropDuplicates(["h"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(h, lang, *(v.tobytes() for t in (text, _snippet(text)) for f in [features(t)] for v in (f[0].astype(np.uint16), f[1]))) for h, lang, text in zip(batch["h"], batch["lang"], batch["text"], strict=True) if len(_codes(text))]
            yield pd.DataFrame(out, columns=["h", "lang", "at", "share", "part_at", "part_share"])

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((r for batch in batches for r in batch.itertuples(index=False)), key=lambda r: r.h)
        read = lambda at, share: (np.frombuffer(at, np.uint16).astype(np.int64), np.frombuffer(share, np.float32))
        model = fit_vectors([(read(r.at, r.share), read(r.part_at, r.part_share)) for r in rows], [r.lang for r in rows])
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    vectors = chosen.mapInPandas(run, "h long, lang string, at binary, share binary, part_at binary, part_share binary")
    found = vectors.repartition(1).mapInPandas(fitted, "model binary").first()
    return pickle.loads(found["model"]) if found else fit([], [])


def predictor(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A function from a text column to struct<lang_pred, score, rejected>; the workers get the text alone."""
    importable(spark)
    sent = spark.sparkContext.broadcast(model)  # BUCKETS x languages numbers

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for texts in batches:
            out = [m.predict(t) for t in texts]
            yield pd.DataFrame({"lang_pred": [o[0] for o in out], "score": [o[1] for o in out], "rejected": [o[0] == UNKNOWN or o[1] < m.threshold for o in out]})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return pandas_udf(run, "lang_pred string, score double, rejected boolean")


def predict(df: DataFrame, model: Model, columns: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """``columns`` of the input with ``lang_pred``, ``score`` and ``rejected``, a row for each input row.

    Only the text decides. A null text, or one without a letter, is ``und`` with
    score 0, and rejected; long texts are read whole; repeated rows have equal
    results; an input column with the name of a result column gives way to it.
    """
    columns = [c for c in columns if c not in ("lang_pred", "score", "rejected")]
    found = predictor(df.sparkSession, model)(F.col("text"))
    return df.select(*[F.col(f"`{c}`") for c in columns], found.alias("text read")).select(*[F.col(f"`{c}`") for c in columns], "text read.*")
