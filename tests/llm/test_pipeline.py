import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(f"word{r.randrange(400)}" for _ in range(n))


ITEM, PASSAGE = prose(90, 25), prose(91, 30)
A, B, C, D, E, G, H = (prose(k, 80) for k in range(7))
#: Null ids, ids with different texts, repeated rows, near copies under one id.
ROWS = [(1, A), (1, f"{B} {PASSAGE}"), (1, f"{B} {PASSAGE}"), (2, f"{C} {PASSAGE}"), (2, D), (3, A), (4, G), (4, G + " more"), (None, f"{E} {PASSAGE}"), (None, H), (None, H), (None, f"{prose(8, 60)} {ITEM}"), (None, None)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in ROWS], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def grouped(rows):
    kept, sets = [], []
    for i, t in ordered(rows):
        w = (t or "").split()
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        if not s or not any(100 * len(s & x) >= 80 * len(s | x) for x in sets):
            kept.append((i, t))
        sets.append(s)
    return kept


def cut(rows):
    seen, out = set(), []
    for i, t in ordered(rows):
        gone, places = set(), range(len(t or "") - 49)
        for p in places:
            if t[p : p + 50] in seen:
                gone |= set(range(p, p + 50))
        seen |= {t[p : p + 50] for p in places}
        rest = t if t is None else "".join(c for p, c in enumerate(t) if p not in gone)
        if rest or not gone:
            out.append((i, rest))
    return out


def clean(rows):
    return [(i, t) for i, t in rows if ITEM not in (t or "")]


@pytest.mark.parametrize(("stage", "want"), [(cp.known_language, lambda rows: [r for r in rows if r[1]]), (cp.one_of_each_group, grouped), (cp.without_repeats, cut), (cp.decontaminated, clean)])
def test_stage_on_null_and_repeated_ids(spark, sf, stage, want):
    got = stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(want(ROWS))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_run_on_null_and_repeated_ids(spark, sf):
    want = clean(cut(grouped([r for r in ROWS if r[1]])))
    got = Counter((r.doc_id, r.decoded_sha256) for r in cp.run(spark, sf).collect())
    assert got == Counter((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in want)
