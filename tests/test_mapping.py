import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hushlake.operators import names, native, walkers
from hushlake.operators.scan import exploded
from hushlake.streaming.restore import Restorer

EMAILS = [f"user{k}@example.com" for k in range(24)]


def test_colliding_tokens_restore_their_own_values(spark):
    """Digests of two digits: several of the values collide, and each still comes back."""
    rows = [(k, f"from {a} to {b}") for k, (a, b) in enumerate(zip(EMAILS, EMAILS[1:] + EMAILS[:1]))] + [(50, None), (51, ""), (52, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("s", native.spans(F.col("text"), native.EMAIL, "EMAIL_ADDRESS", 0.9))
    table = None
    for session in "abcdefgh":
        first = docs.select(F.inline("s")).select(native.token_of(session, F.col("entity_type"), F.col("original"), F.lit(0), 2).alias("t")).distinct().count()
        if first == len(EMAILS):
            continue
        try:
            table = native.mapping(docs.select(F.inline("s")), session, 2).cache()
            assert table.select("token").distinct().count() == len(EMAILS)
            break
        except PySparkException as e:  # a second collision stops the job, and never mixes values
            assert "token collision" in str(e)
            table = None
    assert table is not None
    hidden = native.tokenized(docs, "s", table, "doc_id")
    assert hidden.where(F.contains("text", F.lit("@"))).count() == 0
    back = table.collect()
    known = {r.token: r.original for r in back}
    for r in hidden.collect():
        text = r.text
        for token, value in known.items():
            text = text and text.replace(token, value)
        assert text == dict(rows)[r.doc_id]


def test_a_value_without_a_token_stops_the_job(spark):
    docs = spark.createDataFrame([(1, "a@b.org and c@d.org")], "doc_id long, text string").withColumn("s", native.spans(F.col("text"), native.EMAIL, "EMAIL_ADDRESS", 0.9))
    table = native.mapping(docs.select(F.inline("s")), "s").where("original = 'a@b.org'")
    with pytest.raises(Exception, match="without a token"):
        native.tokenized(docs, "s", table, "doc_id").collect()


def test_bare_tokens(spark):
    table = spark.createDataFrame([("[EMAIL_ADDRESS_0123abcd]", "a@b.org")], "token string, original string")
    t = "EMAIL_ADDRESS_0123abcd"
    rows = [(1, f"{t}, ({t}) x{t} {t}e [{t}] EMAIL_ADDRESS_00000000"), (2, None), (3, "")]
    got = {r.k: r.restored for r in native.restore(spark.createDataFrame(rows, "k int, text string"), table, "k", bare=True).collect()}
    assert got == {1: f"a@b.org, (a@b.org) x{t} {t}e a@b.org EMAIL_ADDRESS_00000000", 2: None, 3: ""}


def test_eviction_over_parts(spark):
    rows = [("s", f"t{k:04d}", k) for k in range(500)] + [("u", "t", 1)]
    table = spark.createDataFrame(rows, "session_id string, token string, first_seen int")
    kept = native.evict(table, 20)
    assert sorted(r.first_seen for r in kept.where("session_id = 's'").collect()) == list(range(480, 500)) and kept.count() == 21
    assert {r.session_id: (r.entries, r.evicted) for r in native.evicted_count(table, 20).collect()} == {"s": (500, 480), "u": (1, 0)}


def test_hostile_json_is_malformed():
    put = str.upper
    for text in ("[" * 200_000, '{"a": NaN}', '{"a": 1e400}', "[-Infinity]"):
        assert walkers.json_text(text, put) == (text, "malformed") and walkers.sniff(text) != "json"


def test_name_words():
    assert all(map(names.name_like, ("Jean-Pierre", "O'Neil", "DUPONT", "Éa", "JEAN-LUC")))
    assert not any(map(names.name_like, ("A", "Marie-", "Pourrais-tu", "word", "JeAn", "", "-")))
    assert names.heuristic("todo: Mme Marie Curie", names.NameLists())[0][2] == 0.75 and names.heuristic("passenger Mme Marie Curie", names.NameLists())[0][2] == 0.9


def test_long_tokens_in_streams():
    token = "[" + "A" * 200 + "_0123abcd]"
    r = Restorer({token: "value"})
    assert "".join([r.feed("x " + token[:150]), r.feed(token[150:] + " y"), r.flush()]) == "x value y"


def test_unscanned_texts_stop_the_job(spark):
    df = spark.sql("SELECT 1 AS k, CAST(NULL AS array<struct<entity_type:string,original:string,start:int,end:int,score:double,replaced:boolean>>) AS spans, 'too_large' AS status")
    with pytest.raises(Exception, match="50 MiB"):
        exploded(df, ["k"]).collect()
