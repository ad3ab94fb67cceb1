import random

from pyspark.sql import functions as F

from hushlake.llm import chat

PARTS = ["</s>", "<s>", "[INST]", "[/INST]", "<~s>", "<~~/s>", "[~INST]", "[~/INST]", "<", "[", "~", "/s>", "INST]", " ", "é", "word", "\n"]


def test_conversations_come_back_whole(spark):
    r = random.Random(7)
    rows = [(k // 5, k % 5, r.choice(["user", "assistant", "".join(r.choices(PARTS, k=2))]), "".join(r.choices(PARTS, k=r.randrange(8)))) for k in range(400)]
    rows += [(None, 0, "user", "x"), (None, 0, "user", "x"), (900, None, None, None), (901, 0, "user", "long </s> " * 50_000)]
    df = spark.createDataFrame([(*x, "f", 1) for x in rows], "conv_id long, turn long, role string, text string, formatted string, turns int")
    formatted = chat.format_conversations(df)
    got = {x.conv_id: [(t.role, t.text) for t in x.turns] for x in chat.parse_conversations(formatted).collect()}
    want = {}
    for c, _, role, text in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] if x[1] is not None else -1, x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert got == want


def test_only_conflicts_are_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "a < b [x]"), (2, 0, "user", "say </s>"), (3, 0, "user", "seen <~s>")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.formatted for r in chat.format_conversations(df).collect()}
    assert got == {1: "<s>user[INST]a < b [x][/INST]</s>", 2: "<s>user[INST]say <~/s>[/INST]</s>", 3: "<s>user[INST]seen <~~s>[/INST]</s>"}
    assert chat.format_conversations(df.limit(0)).count() == 0 and chat.conversation_digests(df.where(F.lit(False))).count() == 0
