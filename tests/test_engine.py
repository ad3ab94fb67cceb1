import itertools

import pytest
from pyspark.sql import functions as F

from hushlake.functions import validators as v
from hushlake.functions.normalize import normalized
from hushlake.operators import layout, native, scan, walkers
from hushlake.operators.scan import Settings, as_rows
from hushlake.plans import registry
from hushlake.streaming.restore import Restorer


def found(text):
    return [(r[0], r[1]) for r in as_rows(text, Settings())]


def test_registry_is_whole():
    r = registry.built_in()
    assert len(r) == 99 and len({x.entity_type for x in r}) == 63
    assert all(0 < x.score <= 1 and (x.keywords or not x.required) for x in r)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Email ada@example.com", [("EMAIL_ADDRESS", "ada@example.com")]),
        ("contact=ada%40example.com", [("EMAIL_ADDRESS", "ada%40example.com")]),
        ("contact=ada\\u0040example.com", [("EMAIL_ADDRESS", "ada\\u0040example.com")]),
        ("Card: 4111\n1111 1111 1111", [("CREDIT_CARD", "4111\n1111 1111 1111")]),
        ("Card: 4111111111111112", []),
        ("device=00:00:00:00:00:00", []),
        ("created_at=2026-02-31", []),
        ("IBAN GB82WEST12345698765432", [("IBAN_CODE", "GB82WEST12345698765432")]),
        ('password="example-pass-123"', [("PASSWORD", 'password="example-pass-123"')]),
        ("Best regards,\nDupont", [("PERSON", "Dupont")]),
        ("", []),
    ],
)
def test_detect(text, want):
    assert found(text) == want


def test_byte_offsets_and_views():
    (row,) = as_rows("é ａｄａ＠example.com", Settings())
    assert (row[2], row[3]) == (3, 3 + len("ａｄａ＠example.com".encode()))
    assert normalized("a%zz +\\ud800").text == "a%zz +\\ud800"


def test_inner_hits_of_urls_are_only_reported():
    rows = as_rows("see https://site.com/s?email=user%40example.com&id=1", Settings())
    assert [(r[0], r[5]) for r in rows] == [("URL", True), ("EMAIL_ADDRESS", False)]


@pytest.mark.parametrize(("f", "good", "bad"), [(v.verhoeff, "2363", "2364"), (v.uk_nhs, "9434765919", "9434765918"), (v.es_nif, "12345678Z", "12345678A"), (v.pl_pesel, "44051401359", "44051401358"), (v.it_fiscal_code, "RSSMRA85T10A562S", "RSSMRA85T10A562A"), (v.fi_identity, "131052-308T", "131052-308U"), (v.sg_nric_fin, "S1234567D", "S1234567A"), (v.aba_routing, "021000021", "021000022")])
def test_validators(f, good, bad):
    assert f(good) and not f(bad)


def test_walkers_change_values_only():
    put = walkers.replacer(Settings(), lambda e, o: f"<{e}>")
    assert walkers.json_text('{"b": "a@b.org", "a@b.org": 1}', put) == ('{\n  "a@b.org": 1,\n  "b": "<EMAIL_ADDRESS>"\n}\n', "ok")
    assert walkers.csv_text('id,m\r\n1,"a@b.org"\r\n', put) == ('id,m\r\n1,"<EMAIL_ADDRESS>"\r\n', "ok")
    assert walkers.csv_text('a"b,c', put)[1] == "malformed"
    assert walkers.sql_text("SELECT E'a@b.org' -- 'c@d.org'", put)[0] == "SELECT E'<EMAIL_ADDRESS>' -- 'c@d.org'"
    assert walkers.sniff("SELECT a FROM t") == "sql" and walkers.sniff("a,b\n1,2\n") == "csv" and walkers.sniff("[1]") == "json"


def test_stream_restores_at_every_split():
    text, known = "x [A_00000001] [b [A_00000001", {"[A_00000001]": "Ada"}
    for a, b in itertools.combinations(range(len(text)), 2):
        r = Restorer(known)
        assert "".join([r.feed(text[:a]), r.feed(text[a:b]), r.feed(text[b:]), r.flush()]) == "x Ada [b [A_00000001"


def test_native_operators(spark):
    df = spark.createDataFrame([(1, "é a@b.org, c@d.org"), (2, ""), (3, None)], "k int, text string")
    s = native.spans(F.col("text"), native.EMAIL, "EMAIL_ADDRESS", 0.9)
    rows = {r.k: r for r in df.select("k", s.alias("s"), native.splice(F.col("text"), s, native.mask("*", 100)).alias("m"), native.splice(F.col("text"), s, native.encrypt("00" * 16)).alias("e")).collect()}
    assert [(x.start, x.end) for x in rows[1].s] == [(3, 10), (12, 19)]
    assert rows[1].m == "é *******, *******" and rows[2].m == ""
    back = spark.createDataFrame([(rows[1].e,)], "e string").select(native.decrypt(F.col("e"), "00" * 16)).first()[0]
    assert back == "é a@b.org, c@d.org"
    found = df.select("k", F.inline(s))
    table = native.mapping(found, "s")
    put = lambda x: native.token_of("s", x["entity_type"], x["original"], F.lit(0))
    hidden = df.select("k", native.splice(F.col("text"), s, put).alias("text"))
    assert {r.k: r.restored for r in native.restore(hidden, table, "k").collect()}[1] == "é a@b.org, c@d.org"


def test_overlapping_spans_are_refused(spark):
    df = spark.sql("SELECT 'abcdef' AS text, array(named_struct('entity_type', 'X', 'original', 'abc', 'start', 0, 'end', 3), named_struct('entity_type', 'X', 'original', 'cd', 'start', 2, 'end', 4)) AS s")
    assert native.apply_spans(df, "text", "s", {"DEFAULT": native.redact}).first().status == "overlapping"


def test_layout(spark):
    w = spark.createDataFrame([(1, 1, 0, "a", 0.0, 10.0, 5.0, 4.0), (1, 1, 1, "b", 9.0, 11.0, 5.0, 4.0), (1, 1, 2, "c", 0.0, 2.0, 5.0, 4.0)], "doc_id int, page int, word_idx int, text string, x double, y double, width double, height double")
    lined = layout.lines(w)
    assert layout.page_text(lined).first().text == "a b\nc"
    hit = spark.createDataFrame([(1, 1, 2, 3, "X")], "doc_id int, page int, start int, end int, entity_type string")
    assert layout.regions(lined, hit).first().x0 == 9.0
