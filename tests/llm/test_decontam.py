import random

import pytest

from hushlake.llm import decontam


def tokens(text):
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower()).split()


def brute(docs, items):
    """All diagonals of all pairs."""
    best = {}
    for i, text in docs:
        for j, item in items:
            d, w = tokens(text), tokens(item)
            for diagonal in range(-len(w) + 1, len(d)):
                pairs = [(d[k + diagonal], w[k]) for k in range(len(w)) if 0 <= k + diagonal < len(d)]
                same = [a == b for a, b in pairs]
                run = hits = top = score = 0
                for eq in same:
                    hits = (hits if run > 0 else 0) + 1 if eq else hits
                    run = max(run, 0) + 1 if eq else run - decontam.PENALTY
                    if run > top:
                        top, score = run, hits
                need = min(decontam.MIN_MATCH, len(w))
                if w and (sum(same) >= need and sum(same) >= decontam.MIN_IDENTITY * len(same) or score >= need):
                    best[i, j] = max(best.get((i, j), (0, 0)), (sum(same), len(same)))
    return {(i, j, *v) for (i, j), v in best.items()}


def prose(r, n):
    return " ".join(f"w{r.randrange(300)}" for _ in range(n))


@pytest.mark.parametrize("bound", [decontam.MAX_BROADCAST, 0])
def test_overlaps_match_brute_force(spark, bound):
    r = random.Random(5)
    items = [(k, prose(r, r.choice([3, 9, 14, 30, 60]))) for k in range(8)] + [(100, "a " * 40), (101, None), (102, "")]
    docs = [(None, None), (0, ""), (1, "a " * 60), (2, prose(r, 3000))]
    for k in range(30):
        w = tokens(r.choice(items[:8])[1])
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            w[r.randrange(len(w))] = "other"
        docs.append((10 + k if k % 7 else None, f"{prose(r, 30)} {' '.join(w)} {prose(r, 30)}"))
    docs += [docs[5], (docs[6][0], docs[8][1])]  # a repeated row, and an id with two texts
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, item_id int, w string")
    b = spark.createDataFrame([(j, t, 1) for j, t in items] + [(0, items[0][1], 1)], "item_id long, text string, doc_id int")
    got = {(x.doc_id, x.item_id, x.matched, x.overlap) for x in decontam.overlaps(d, b, max_broadcast=bound).collect()}
    assert got == brute(docs, items)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontam.overlaps(d, b).count() == 0 and decontam.clean(d, b).count() == 1
    assert decontam.overlaps(d.limit(0), b).count() == 0
