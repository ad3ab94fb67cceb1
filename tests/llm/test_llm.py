import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from hushlake.llm import bpe, chat, chunks, decontam, flac, html, langid, license, minhash, suffix
from hushlake.llm.common import scratch

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, hi int, n int"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base, passage = prose(1, 120), prose(2, 70)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [(0, base), (1, base), (2, near), (3, prose(3, 90) + " " + passage), (4, prose(4, 90) + " " + passage + " é"), (5, prose(5, 60)), (6, ""), (7, None), (None, prose(6, 80)), (8, "one two"), (9, "one  TWO"), (10, "a" * 3000), (11, "b" * 3000), (5, prose(5, 60)), (12, "x")]
    return spark.createDataFrame([(i, t, "en", 0, 0) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substring_dedup(docs, empty):
    got = chunks.repeated_spans(docs).collect()
    assert {r.doc_id for r in got} == {1, 2, 4} and all(r.end - r.start >= 100 for r in got)
    assert chunks.repeated_spans(empty).count() == 0


def test_substring_dedup_of_short_texts_and_passages(spark):
    short = "A short text, repeated."
    passages = [prose(100 + k, 36)[:130] for k in range(40)]
    rows = [(1, short), (2, short), (3, "Another short one."), (4, short)]
    rows += [(10 + k, prose(200 + k, 60) + " " + p + " " + prose(300 + k, 60)) for k, p in enumerate(passages)]
    rows += [(110 + k, prose(400 + k, 60) + " " + p + " " + prose(500 + k, 60)) for k, p in enumerate(passages)]
    got = {r.doc_id: r for r in chunks.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(short)
    assert [(got[i].start, got[i].end, got[i].first_doc_id) for i in (2, 4)] == [(0, n, 1)] * 2 and not {1, 3} & set(got)
    texts = dict(rows)
    found = [k for k, p in enumerate(passages) if 110 + k in got]
    assert all(passages[k] in texts[110 + k][got[110 + k].start : got[110 + k].end] and got[110 + k].first_doc_id == 10 + k for k in found)
    shared = [k for k, p in enumerate(passages) if _share_a_chunk(texts[10 + k], texts[110 + k])]
    assert set(shared) <= set(found) and len(shared) > 20
    assert not set(got) & set(range(10, 110))


def _share_a_chunk(a, b):
    pieces = []
    for t in (a.encode(), b.encode()):
        ends = chunks.cuts(np.frombuffer(t, np.uint8)).tolist()
        pieces.append({t[x:y] for x, y in zip([0, *ends], ends)})
    return bool(pieces[0] & pieces[1])


def _shuffled_rows(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_substring_dedup_exchanges_a_chunk_once(spark):
    texts = [prose(1000 + k, 150) for k in range(300)]
    df = spark.createDataFrame([*enumerate(texts), (300, texts[0])], "doc_id long, text string")
    n = sum(len(chunks.cuts(np.frombuffer(t.encode(), np.uint8))) for t in texts)
    before = _shuffled_rows(spark)
    assert [(r.doc_id, r.first_doc_id) for r in chunks.repeated_spans(df).collect() if r.start == 0 and r.end == len(texts[0])] == [(300, 0)]
    assert n < _shuffled_rows(spark) - before < 1.7 * n


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("at_once", [300, 1 << 22])
def test_substring_dedup_finds_the_smallest_place_of_each_chunk(spark, monkeypatch, kind, at_once):
    monkeypatch.setattr(chunks, "AT_ONCE", at_once)
    line, own = prose(600, 40), prose(601, 40)
    rows = [(i, f"{prose(700 + i, 20)} {line} {prose(800 + i % 7, 30)} é") for i in random.Random(1).sample(range(2, 60), 50)]
    rows += [(1, f"{own} {own} {own}"), (61, " ".join([line] * 9)), (62, "z" * 9000), (63, "z" * 5000), (64, ""), (65, None), rows[0], (rows[1][0], "other " + rows[2][1])]
    rows = [(str(i) if kind == "string" else i, t) for i, t in rows]
    places = {}
    for i, t in rows:
        raw = (t or "").encode()
        ends = chunks.cuts(np.frombuffer(raw, np.uint8)).tolist()
        for a, b in zip([0, *ends], ends):
            places.setdefault(raw[a:b], set()).add((i, a))
    expected = sorted((i, a, *min(found)) for found in places.values() for i, a in found if i > min(found)[0])
    with scratch(spark):
        got = chunks._again(spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)).distinct()
        assert sorted(tuple(r) for r in got.select("doc_id", "start", "first_doc_id", "held_at").collect()) == expected


def test_substring_dedup_bytes_in_common(spark):
    r = random.Random(7)
    rows = [(b"", b"a", True), (b"", b"", False)]
    for same in [0, 1, 2, 63, 64, 100, 2111, 4160] * 3:
        shared, a, b = r.randbytes(same), b"\x00" + r.randbytes(r.randrange(3)), b"\xff" + r.randbytes(r.randrange(3))
        rows += [(shared + a, shared + b, False), (a[::-1] + shared, b[::-1] + shared, True), (shared, shared + b, False), (b[::-1] + shared, shared, True)]
    df = spark.createDataFrame([(bytearray(a), bytearray(b), left) for a, b, left in rows], "ours binary, theirs binary, left boolean")

    def in_common(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    expected = [in_common(a[::-1], b[::-1]) if left else in_common(a, b) for a, b, left in rows]
    assert [x.n for x in df.select(chunks._in_common().alias("n")).collect()] == expected


def test_chunks_cover_and_resist_shifts():
    data = prose(9, 2000).encode()
    a, b = chunks.cuts(np.frombuffer(data, np.uint8)), chunks.cuts(np.frombuffer(b"shift " + data, np.uint8))
    assert a[-1] == len(data) and len(set((b - 6).tolist()) & set(a.tolist())) > 0.95 * len(a)


def _components(rows, percent, size):
    sets = [set(zip(*[w[k:] for k in range(min(size, len(w)))])) if (w := (t or "").lower().split()) else set() for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    low = {}
    for (i, _), x in zip(rows, label):
        if i is not None:
            low[x] = min(low.get(x, i), i)
    return sorted((str(i), len(s), low.get(x)) for (i, _), s, x in zip(rows, sets, label))


def test_minhash_matches_brute_force(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect())
    assert got == _components(rows, 85, 3)
    assert minhash.near_duplicates(empty).count() == 0


def test_signature_estimates_similarity():
    a = np.arange(2000, dtype=np.uint64) * np.uint64(2654435761)
    s = minhash.signatures([a[:1800], a[200:]])
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.12


def _removed(rows):
    first = {}
    key = lambda i: 1 << 62 if i is None else i
    for i, t in sorted(rows, key=lambda r: key(r[0])):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        m = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < key(i):
                m[p : p + 50] = True
        rest = bytes(x for x, gone in zip(b, m) if not gone)
        out.append((str(i), len(b), int(m.sum()), int(m[:1].sum() + (m[1:] & ~m[:-1]).sum()), hashlib.sha256(rest).hexdigest()))
    return sorted(out)


def test_suffix_dedup_matches_brute_force(docs, empty, monkeypatch):
    monkeypatch.setattr(suffix, "RUN_BYTES", 2500)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = suffix.remove_repeats(docs, "sha256").collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == _removed(rows)
    assert suffix.remove_repeats(empty).count() == 0


def test_loser_tree_merges():
    r = random.Random(5)
    runs = []
    for _ in range(5):
        rows = sorted({bytes(r.choice(b"ab") for _ in range(suffix._WIDTH)) for _ in range(r.randint(0, 30))})
        m = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, suffix._WIDTH)
        runs.append(suffix.front_decode(suffix.front_code(m), len(rows)))
        assert runs[-1][0] == rows
    of, at, common = suffix.merge(runs)
    out = [runs[a][0][b] for a, b in zip(of, at)]
    assert out == sorted(x for s, _ in runs for x in s)
    assert all(c == next((k for k in range(suffix._WIDTH) if p[k] != q[k]), suffix._WIDTH) for p, q, c in zip(out, out[1:], common[1:]))


def test_main_text():
    page = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=x>menu</a></nav><article><h1>Head</h1><p>One &amp;  two<p>three</article><div class='comments'><p>reader</p></div><footer>&copy; x</footer>"
    assert html.main_text(page) == "Head One & two three"
    assert html.main_text(None) == html.main_text("") == ""
    long = "the of and to in a is that it for on with as was are " * 4
    assert html.main_text(f"<ul><li><a href=a>the link of links</a></li></ul><h2>Title</h2><p>{long}</p><p>short end</p><div class=footer>x</div>").startswith("Title the of")


def test_licenses(docs, spark, empty):
    df = spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0. All rights reserved."), (2, None), (3, "GNU General Public License, version 3; general public license"), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in license.summary(df).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels) == (10, 2, 2, 7, "cc-by,reserved", "cc-by,cc-by-nc-4.0,reserved")
    assert (got[2].n_words, got[2].first_word, got[2].labels, got[2].score) == (0, None, "", 0.0)
    assert got[3].labels == "gpl,gpl-3.0" and got[3].n_base == 2
    assert license.summary(empty).count() == 0


def test_decontamination(spark, docs, empty):
    item = prose(77, 30)
    changed = item.split()
    changed[7] = changed[18] = "other"
    d = spark.createDataFrame([(1, prose(8, 50) + " " + item.upper() + " " + prose(10, 50)), (2, prose(8, 40) + " " + " ".join(changed)), (3, prose(11, 200)), (4, None), (5, "")], "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (2, None), (3, "too short")], "item_id long, text string")
    for bound in (decontam.MAX_BROADCAST, 0):
        assert {(r.doc_id, r.item_id) for r in decontam.overlaps(d, b, max_broadcast=bound).collect()} == {(1, 1), (2, 1)}
    assert {r.doc_id for r in decontam.clean(d, b).collect()} == {3, 4, 5}
    assert decontam.overlaps(empty, b).count() == 0


def test_decontamination_by_short_items(spark):
    d = spark.createDataFrame([(1, prose(8, 50) + " alpha beta gamma " + prose(10, 50)), (2, "Alpha, beta!"), (3, prose(11, 50) + " alpha beta other"), (4, "one item of seven words is here"), (5, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta"), (3, "One item of seven words is here"), (4, "")], "item_id long, text string")
    for bound in (decontam.MAX_BROADCAST, 0):
        assert {(r.doc_id, r.item_id) for r in decontam.overlaps(d, b, max_broadcast=bound).collect()} == {(1, 1), (1, 2), (2, 2), (3, 2), (4, 3)}


def test_masks_leave_no_accepted_overlap():
    for n in range(10, 21):
        lost = n - max(decontam.MIN_MATCH, -(-4 * n // 5))
        places = [sum(1 << (p + i) for i, bit in enumerate(m) if bit == "1") for m in decontam.MASKS for p in range(n - len(m) + 1)]
        assert all(any(not s & p for p in places) for s in (sum(1 << i for i in c) for c in itertools.combinations(range(n), lost)))


def test_language_id(spark, empty):
    words = {"en": "the of and to in is that house water".split(), "de": "der die und zu ein ist nicht haus wasser".split()}
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(20)), lang) for i, lang in enumerate(["en", "de"] * 150)]
    df = spark.createDataFrame([*rows, (1000, None, None), (1001, "12 34", None)], "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in langid.predict(df, langid.train(df)).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) / len(rows) > 0.98
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1001].rejected
    assert langid.train(empty).languages == []


def test_bpe(docs, empty):
    enc = bpe.encoding(RANKS, PATTERN)
    for t in ["", "héllo  world\n\n x", "日本語 " * 50, prose(1, 30000)]:
        ids = enc.encode_ordinary(t)
        assert bpe.encode(t, RANKS, PATTERN) == ids and bpe.decode(ids, RANKS, PATTERN) == t.encode()
    assert bpe.encode_documents(docs, RANKS, PATTERN).count() == docs.count()
    assert bpe.encode_documents(empty, RANKS, PATTERN, digests_only=True).count() == 0


def test_flac(docs):
    r = np.random.default_rng(0)
    for data in (b"\0" * 64, bytes(r.integers(0, 256, 5000, dtype=np.uint8)), bytes((128 + 50 * np.sin(np.arange(9000) / 40)).astype(np.uint8)), prose(1, 3000).encode()):
        media = flac.encode(data)
        assert flac.decode(media) == data and flac.read_range(media, 100, 77) == data[100:177]
        broken = bytearray(media)
        broken[-3] ^= 1
        with pytest.raises(flac.Damaged):
            flac.decode(bytes(broken))
    rows = flac.media_column(docs, with_media=True)
    assert rows.where("payload_bytes % 64 <> 0 OR payload_bytes < 64").count() == 0
    assert flac.pcm_blocks(rows).agg(F.sum("n_samples")).first()[0] == rows.agg(F.sum("payload_bytes")).first()[0]


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<~/s>", "[~~INST]", "plain", None, "", "<s", "["]
    df = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(texts)] + [(2, 0, None, "x"), (2, 0, None, "x")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.parse_conversations(chat.format_conversations(df)).collect()}
    assert [t.text for t in got[1].turns] == [t or "" for t in texts]
    assert [(t.role, t.text) for t in got[2].turns] == [("", "x")] * 2
    odd = spark.createDataFrame([(1, "<s>[INST]x"), (2, "")], "conv_id long, formatted string")
    assert {r.conv_id: r.turns for r in chat.parse_conversations(odd).collect()} == {1: None, 2: []}
