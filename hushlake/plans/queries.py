"""The registered queries of the privacy engine and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from hushlake.functions import checksums
from hushlake.functions.normalize import normalized, strip_marks
from hushlake.operators import evaluate, layout, native, scan, walkers
from hushlake.plans import registry

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SESSION = "demo-session"
KEY = "000102030405060708090a0b0c0d0e0f"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SHAPES = {"email": (native.EMAIL, "EMAIL_ADDRESS", 0.9), "ipv4": (native.IPV4, "IP_ADDRESS", 0.9), "card": (native.CARD, "CREDIT_CARD", 0.7), "phone": (native.PHONE, "PHONE_NUMBER", 0.6)}


def _sql_spans(shape: str, table: str = "documents", key: str = "doc_id", col: str = "text") -> str:
    """DuckDB rows (key, entity_type, original, start, end, score) of one shape."""
    pattern, entity, score = SHAPES[shape]
    return f"""SELECT {key}, '{entity}' AS entity_type, m[i] AS original,
      CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: strlen(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: strlen(x))), 0) AS INT) AS "start",
      CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: strlen(x))), 0) + coalesce(list_sum(list_transform(m[1:i], lambda x: strlen(x))), 0) AS INT) AS "end", {score}::DOUBLE AS score
      FROM (SELECT {key}, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {key}, regexp_extract_all({col}, {_quoted(pattern)}) AS m, string_split_regex({col}, {_quoted(pattern)}) AS g FROM {table}))"""


def _spark_spans(df: DataFrame, shape: str, key: str = "doc_id", col: str = "text") -> DataFrame:
    return df.select(key, F.inline(native.spans(F.col(col), *SHAPES[shape])))


for _name in SHAPES:
    register(f"detect_{_name}", _sql_spans(_name))(lambda spark, d, n=_name: _spark_spans(_table(spark, d, "documents"), n))

ORACLES["detect_email_pages"] = _sql_spans("email", "pages", "page_id", "html")
register("detect_email_pages", ORACLES["detect_email_pages"])(lambda spark, d: _spark_spans(_table(spark, d, "pages"), "email", "page_id", "html"))


def _all_spans(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    found = F.concat(*[native.spans(F.col("text"), *SHAPES[n]) for n in SHAPES])
    return docs.select("doc_id", "text", found.alias("spans"))


_UNION = " UNION ALL ".join(f"({_sql_spans(n)})" for n in SHAPES)


@register("detections_summary", f"SELECT entity_type, count(*) AS n, count(DISTINCT doc_id) AS n_docs, count(DISTINCT original) AS n_values FROM ({_UNION}) GROUP BY entity_type")
def detections_summary(spark: SparkSession, d: str) -> DataFrame:
    found = _all_spans(spark, d).select("doc_id", F.inline("spans"))
    return found.groupBy("entity_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("original").alias("n_values"))


@register("share_summary", f"SELECT entity_type, count(*) AS n FROM (SELECT DISTINCT entity_type, original FROM ({_UNION})) GROUP BY entity_type")
def share_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.share_summary(_all_spans(spark, d).select(F.inline("spans")))


@register("masked_report", f"SELECT DISTINCT entity_type, masked, score FROM (SELECT DISTINCT entity_type, original, CASE WHEN length(original) <= 2 THEN repeat('*', length(original)) ELSE left(original, 1) || '***' || right(original, 1) END AS masked, round(score, 2) AS score FROM ({_UNION}))")
def masked_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.masked_report(_all_spans(spark, d).select(F.inline("spans"))).distinct()


@register("threshold_sweep", f"SELECT t AS threshold, count(*) AS n FROM ({_UNION}) CROSS JOIN (SELECT CAST(unnest([0.0, 0.5, 0.65, 0.8, 0.9]) AS DOUBLE) AS t) WHERE score >= t GROUP BY t")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    found = _all_spans(spark, d).select(F.inline("spans")).groupBy("score").agg(F.count("*").alias("k"))
    return found.select("k", "score", F.explode(F.array(*map(F.lit, (0.0, 0.5, 0.65, 0.8, 0.9)))).alias("threshold")).where("score >= threshold").groupBy("threshold").agg(F.sum("k").alias("n"))


@register("overlap_resolved", f"""WITH s AS ({_UNION}), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC, score DESC, entity_type) AS k FROM s)
  SELECT doc_id, entity_type, original, "start", "end", score FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.doc_id = a.doc_id AND b.k < a.k AND b."end" > a."start"
    AND NOT EXISTS (SELECT 1 FROM o c WHERE c.doc_id = b.doc_id AND c.k < b.k AND c."end" > b."start"))""")
def overlap_resolved(spark: SparkSession, d: str) -> DataFrame:
    return _all_spans(spark, d).select("doc_id", F.inline(native.resolve(F.col("spans"))))


_CARD_WORDS = ("card", "credit", "payment", "cc", "visa", "mastercard", "amex", "cb", "carte", "bancaire", "debit", "paiement")


@register("detect_card_ctx", f"""SELECT doc_id, original, "start", (SELECT bool_or(contains(w, k)) FROM (SELECT unnest([{", ".join(map(_quoted, _CARD_WORDS))}]) AS k)) AS in_context, len(original) AS n FROM (
  SELECT s.doc_id, s.original, s."start", lower(decode(encode(d.text)[greatest(s."start" - 80, 0) + 1 : s."end" + 80])) AS w FROM ({_sql_spans("card", "(SELECT doc_id, 'Card ' || regexp_replace(text, '[^ -~]', '?', 'g') AS text FROM documents)")}) s
  JOIN (SELECT doc_id, 'Card ' || regexp_replace(text, '[^ -~]', '?', 'g') AS text FROM documents) d USING (doc_id)) WHERE len(regexp_replace(original, '[^0-9]', '', 'g')) >= 13
  AND list_sum(list_transform(range(0, 16), lambda i: CASE WHEN i % 2 = 0 THEN CASE WHEN 2 * CAST(regexp_replace(original, '[^0-9]', '', 'g')[i + 1] AS INT) > 9 THEN 2 * CAST(regexp_replace(original, '[^0-9]', '', 'g')[i + 1] AS INT) - 9 ELSE 2 * CAST(regexp_replace(original, '[^0-9]', '', 'g')[i + 1] AS INT) END ELSE CAST(regexp_replace(original, '[^0-9]', '', 'g')[i + 1] AS INT) END)) % 10 = 0""")
def detect_card_ctx(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("Card "), F.regexp_replace("text", "[^ -~]", "?"))
    docs = _table(spark, d, "documents").select("doc_id", t.alias("t"))
    found = docs.select("doc_id", "t", F.inline(native.spans(F.col("t"), *SHAPES["card"]))).where(checksums.luhn(F.col("original")))
    window = F.lower(F.substr("t", F.greatest(F.col("start") - 80, F.lit(0)) + 1, F.col("end") + 80 - F.greatest(F.col("start") - 80, F.lit(0))))
    near = F.exists(F.array(*map(F.lit, _CARD_WORDS)), lambda k: F.contains(window, k))
    return found.select("doc_id", "original", "start", near.alias("in_context"), F.length("original").cast("long").alias("n"))


def _spliced_sql(shape: str, put: str) -> str:
    p = _quoted(SHAPES[shape][0])
    return f"SELECT doc_id, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || CASE WHEN i <= len(m) THEN {put.replace('{x}', 'm[i]')} ELSE '' END), '') AS result FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS g FROM documents WHERE text IS NOT NULL)"


_OPERATORS: dict[str, tuple[Callable[[Column], Column], str | None]] = {
    "op_redact": (native.redact, "''"),
    "op_keep": (lambda x: x["original"], "{x}"),
    "op_mask": (native.mask(), "repeat('*', length({x}))"),
    "op_mask_from_end": (native.mask("#", 4, True), "substr({x}, 1, length({x}) - least(4, length({x}))) || repeat('#', least(4, length({x})))"),
    "op_hash_sha256": (native.hashed("sha256"), "sha256({x})"),
    "op_hash_sha512": (native.hashed("sha512"), None),
    "op_hash_md5": (native.hashed("md5"), "md5({x})"),
    "op_custom": (native.custom("<{entity_type}>"), "'<EMAIL_ADDRESS>'"),
}
for _name, (_put, _sql) in _OPERATORS.items():
    register(_name, _spliced_sql("email", _sql) if _sql else None)(lambda spark, d, put=_put: _table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", native.splice(F.col("text"), native.spans(F.col("text"), *SHAPES["email"]), put).alias("result")))


@register("op_encrypt")
def op_encrypt(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", native.splice(F.col("text"), native.spans(F.col("text"), *SHAPES["email"]), native.encrypt(KEY)).alias("result"))


@register("op_encrypt_roundtrip", "SELECT doc_id, text AS restored FROM documents")
def op_encrypt_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return op_encrypt(spark, d).select("doc_id", native.decrypt(F.col("result"), KEY).alias("restored"))


@register("op_per_entity", "SELECT doc_id, regexp_replace(regexp_replace(text, " + _quoted(native.EMAIL) + ", '', 'g'), " + _quoted(native.IPV4) + ", '[IP_ADDRESS]', 'g') AS result, 'ok' AS status FROM documents WHERE text IS NOT NULL")
def op_per_entity(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").where("text IS NOT NULL")
    found = native.resolve(F.concat(native.spans(F.col("text"), *SHAPES["email"]), native.spans(F.col("text"), *SHAPES["ipv4"])))
    return native.apply_spans(docs.withColumn("s", found), "text", "s", {"EMAIL_ADDRESS": native.redact, "DEFAULT": native.custom("[{entity_type}]")}).select("doc_id", "result", "status")


def _tokens(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Texts with tokens from the mapping, and the mapping."""
    docs = _table(spark, d, "documents").select("doc_id", "text", native.spans(F.col("text"), *SHAPES["email"]).alias("spans"))
    table = native.mapping(docs.select(F.inline("spans")), SESSION)
    return native.tokenized(docs, "spans", table, "doc_id"), table


_TOKEN_SQL = "'[EMAIL_ADDRESS_' || substr(sha256('" + SESSION + "' || chr(1) || 'EMAIL_ADDRESS' || chr(1) || {x} || chr(1) || '0'), 1, 8) || ']'"


@register("mapping_table", f"SELECT DISTINCT '{SESSION}' AS session_id, {_TOKEN_SQL.replace('{x}', 'original')} AS token, entity_type, original FROM ({_sql_spans('email')})")
def mapping_table(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d)[1]


@register("op_token", _spliced_sql("email", _TOKEN_SQL))
def op_token(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d)[0].where("text IS NOT NULL").select("doc_id", F.col("text").alias("result"))


@register("mapping_evict", f"SELECT original FROM (SELECT original, row_number() OVER (ORDER BY first_seen DESC, token DESC) AS k FROM (SELECT original, min(doc_id) AS first_seen, {_TOKEN_SQL.replace('{x}', 'original')} AS token FROM ({_sql_spans('email')}) GROUP BY original)) WHERE k <= 5")
def mapping_evict(spark: SparkSession, d: str) -> DataFrame:
    seen = _spark_spans(_table(spark, d, "documents"), "email").groupBy("original").agg(F.min("doc_id").alias("first_seen"))
    return native.evict(mapping_table(spark, d).join(seen, "original"), 5).select("original")


@register("restore_roundtrip", "SELECT doc_id, text AS restored FROM documents")
def restore_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    texts, table = _tokens(spark, d)
    return native.restore(texts, table, "doc_id")


@register("restore_unknown_tokens", "SELECT doc_id, '[x [EMAIL_ADDRESS_00000000]] ' || text AS restored FROM documents")
def restore_unknown_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts behind a token that the mapping hasn't."""
    texts, table = _tokens(spark, d)
    odd = _table(spark, d, "documents").select("doc_id", F.concat(F.lit("[x [EMAIL_ADDRESS_00000000]] "), F.col("text")).alias("text"))
    return native.restore(odd, table, "doc_id")


_BARE_SQL = f"regexp_replace({_TOKEN_SQL.replace('{x}', 'original')}, '[][]', '', 'g')"


@register("restore_bare", f"SELECT original, 'see ' || original || ', x' || b || ' ' || original || ' ' || b || '0' AS restored FROM (SELECT DISTINCT original, {_BARE_SQL} AS b FROM ({_sql_spans('email')}))")
def restore_bare(spark: SparkSession, d: str) -> DataFrame:
    """Tokens with and without brackets, and two that touch a letter or a digit."""
    table = mapping_table(spark, d)
    b = F.regexp_replace("token", r"[\[\]]", "")
    rows = table.select("original", F.concat(F.lit("see "), b, F.lit(", x"), b, F.lit(" "), F.col("token"), F.lit(" "), b, F.lit("0")).alias("text"))
    return native.restore(rows, table, "original", bare=True)


@register("mapping_evicted_count", f"SELECT '{SESSION}' AS session_id, count(DISTINCT original) AS entries, greatest(count(DISTINCT original) - 5, 0) AS evicted FROM ({_sql_spans('email')}) HAVING count(*) > 0")
def mapping_evicted_count(spark: SparkSession, d: str) -> DataFrame:
    return native.evicted_count(mapping_table(spark, d), 5)


def _number(n: int, key: str = "o_orderkey") -> tuple[Callable[[], Column], str]:
    """Zero-padded n-digit strings spread by a multiplication, alike in both engines."""
    sql = f"lpad(CAST(({key} * 7919000 + {key} * {key} * 31 + 104729) % {10**n} AS VARCHAR), {n}, '0')"
    column = lambda: F.lpad(((F.col(key) * 7919000 + F.col(key) * F.col(key) * 31 + 104729) % 10**n).cast("string"), n, "0")  # noqa: E731  columns need a session, which a mere import has not
    return column, sql


for _name, (_n, _, _) in checksums.RULES.items():
    _col, _sql = _number(_n)
    register(f"val_{_name}", f"SELECT o_orderkey, v AS value, {checksums.rule_sql(_name, 'v')} AS valid FROM (SELECT o_orderkey, {_sql} AS v FROM orders)")(
        lambda spark, d, n=_name, c=_col: _table(spark, d, "orders").select("o_orderkey", c().alias("value")).withColumn("valid", checksums.rule(n, F.col("value")))
    )

_LUHN_SQL = "list_sum(list_transform(range(0, 16), lambda i: CASE WHEN i % 2 = 0 THEN CASE WHEN 2 * CAST(v[i + 1] AS INT) > 9 THEN 2 * CAST(v[i + 1] AS INT) - 9 ELSE 2 * CAST(v[i + 1] AS INT) END ELSE CAST(v[i + 1] AS INT) END)) % 10 = 0"
register("val_luhn", f"SELECT o_orderkey, v AS value, {_LUHN_SQL} AS valid FROM (SELECT o_orderkey, {_number(16)[1]} AS v FROM orders)")(
    lambda spark, d: _table(spark, d, "orders").select("o_orderkey", _number(16)[0]().alias("value")).withColumn("valid", checksums.luhn(F.col("value")))
)
register("val_iban", f"SELECT o_orderkey, 'GB' || v AS value, CAST(substr(v, 3) || '1611' || substr(v, 1, 2) AS HUGEINT) % 97 = 1 AS valid FROM (SELECT o_orderkey, {_number(16)[1]} AS v FROM orders)")(
    lambda spark, d: _table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("GB"), _number(16)[0]()).alias("value")).withColumn("valid", checksums.iban(F.col("value")))
)
register("val_calendar", "SELECT o_orderkey, v AS value, try_cast(v AS DATE) IS NOT NULL AS valid FROM (SELECT o_orderkey, (1990 + o_orderkey % 40)::VARCHAR || '-' || lpad((o_orderkey % 13)::VARCHAR, 2, '0') || '-' || lpad((o_orderkey * 7 % 33)::VARCHAR, 2, '0') AS v FROM orders)")(
    lambda spark, d: _table(spark, d, "orders").select("o_orderkey", F.concat((1990 + F.col("o_orderkey") % 40).cast("string"), F.lit("-"), F.lpad((F.col("o_orderkey") % 13).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("o_orderkey") * 7 % 33).cast("string"), 2, "0")).alias("value")).withColumn("valid", F.try_to_date("value", "yyyy-MM-dd").isNotNull())
)
register("val_nif", "SELECT o_orderkey, v || chr(65 + CAST(o_orderkey % 26 AS INT)) AS value, substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(CAST(v AS INT) % 23 AS INT) + 1, 1) = chr(65 + CAST(o_orderkey % 26 AS INT)) AS valid FROM (SELECT o_orderkey, " + _number(8)[1] + " AS v FROM orders)")(
    lambda spark, d: _table(spark, d, "orders").select("o_orderkey", _number(8)[0]().alias("v"), F.char(65 + F.col("o_orderkey") % 26).alias("c")).select("o_orderkey", F.concat("v", "c").alias("value"), (F.substr(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), F.col("v").cast("int") % 23 + 1, F.lit(1)) == F.col("c")).alias("valid"))
)


def _python_rule(entity: str) -> Column:
    from hushlake.functions.validators import BY_TYPE

    return pandas_udf(lambda s: s.map(BY_TYPE[entity]), "boolean")


@register("val_by_registry")
def val_by_registry(spark: SparkSession, d: str) -> DataFrame:
    """Rules that Python is clearer for: Verhoeff, fiscal code, identity codes, insurance numbers."""
    scan.importable(spark)
    k = F.col("c_custkey")
    twelve, nine = F.concat(F.lit("4"), F.lpad((k * 7919 % 100000000000).cast("string"), 11, "0")), F.concat(F.lit("S"), F.lpad((k * 7919 % 10000000).cast("string"), 7, "0"), F.char(65 + k % 26))
    return _table(spark, d, "customer").select("c_custkey", _python_rule("IN_AADHAAR")(twelve).alias("aadhaar"), _python_rule("SG_NRIC_FIN")(nine).alias("nric"), _python_rule("IT_FISCAL_CODE")(F.concat(F.lit("RSSMRA85T10A562"), F.char(65 + k % 26))).alias("fiscal"), _python_rule("FI_PERSONAL_IDENTITY_CODE")(F.concat(F.lit("131052-"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("T"))).alias("hetu"), _python_rule("UK_NINO")(F.concat(F.lit("AB"), F.lpad((k % 1000000).cast("string"), 6, "0"), F.lit("A"))).alias("nino"), _python_rule("MAC_ADDRESS")(F.lpad(F.hex(k), 12, "0")).alias("mac"))


@register("detect_registry")
def detect_registry(spark: SparkSession, d: str) -> DataFrame:
    return scan.exploded(scan.detections(_table(spark, d, "documents")), ["doc_id"])


@register("detect_registry_pages")
def detect_registry_pages(spark: SparkSession, d: str) -> DataFrame:
    return scan.exploded(scan.detections(_table(spark, d, "pages"), "html"), ["page_id"])


@register("url_inner_params", "SELECT page_id, url AS original, 'URL' AS entity_type, true AS replaced FROM pages UNION ALL SELECT page_id, 'u' || page_id || '%40example.com', 'EMAIL_ADDRESS', false FROM pages")
def url_inner_params(spark: SparkSession, d: str) -> DataFrame:
    mark = F.concat(F.when(F.contains("url", F.lit("?")), "&mail=").otherwise("?mail="), F.lit("u"), F.col("page_id").cast("string"), F.lit("%40example.com"))
    found = scan.exploded(scan.detections(_table(spark, d, "pages").select("page_id", "url", F.concat("url", mark).alias("long")), "long"), ["page_id", "url"])
    return found.where("entity_type IN ('URL', 'EMAIL_ADDRESS')").select("page_id", F.when(F.col("entity_type") == "URL", F.col("url")).otherwise(F.col("original")).alias("original"), "entity_type", "replaced")


@register("signoff_names", "SELECT doc_id, 'PERSON' AS entity_type, 'Dupont' AS original FROM documents WHERE text IS NOT NULL")
def signoff_names(spark: SparkSession, d: str) -> DataFrame:
    """Names in the whole texts, with a sign-off put behind each. The SQL knows that one name only: it differs where a text holds another."""
    docs = _table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.concat("text", F.lit("\n\nsee below.\nBest regards,\nDupont")).alias("text"))
    return scan.exploded(scan.detections(docs), ["doc_id"]).where("entity_type = 'PERSON'").select("doc_id", "entity_type", "original")


@register("format_sniff", "SELECT event_id, 'json' AS fmt FROM events WHERE props IS NOT NULL")
def format_sniff(spark: SparkSession, d: str) -> DataFrame:
    scan.importable(spark)
    return _table(spark, d, "events").where("props IS NOT NULL").select("event_id", walkers.format_of(F.col("props")).alias("fmt"))


def _payload(name: str, make: Callable[[], Column], out: str) -> None:
    @register(name, out)
    def query(spark: SparkSession, d: str) -> DataFrame:
        scan.importable(spark)
        put = walkers.replacer(scan.Settings(), lambda entity, _: f"<{entity}>")
        return _table(spark, d, "events").select("event_id", walkers.rewritten(make(), put).alias("r")).select("event_id", "r.fmt", "r.text", "r.status")


_user = lambda: F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com"))
_payload("json_walk", lambda: F.concat(F.lit('{"user": "'), _user(), F.lit('", "id": '), F.col("event_id").cast("string"), F.lit("}")), "SELECT event_id, 'json' AS fmt, '{' || chr(10) || '  \"id\": ' || event_id || ',' || chr(10) || '  \"user\": \"<EMAIL_ADDRESS>\"' || chr(10) || '}' || chr(10) AS text, 'ok' AS status FROM events")
_payload("csv_walk", lambda: F.concat(F.lit("id,mail\n"), F.col("event_id").cast("string"), F.lit(',"'), _user(), F.lit('"\n')), "SELECT event_id, 'csv' AS fmt, 'id,mail' || chr(10) || event_id || ',\"<EMAIL_ADDRESS>\"' || chr(10) AS text, 'ok' AS status FROM events")
_payload("sql_walk", lambda: F.concat(F.lit("SELECT * FROM t WHERE mail = '"), _user(), F.lit("' AND id = "), F.col("event_id").cast("string")), "SELECT event_id, 'sql' AS fmt, 'SELECT * FROM t WHERE mail = ''<EMAIL_ADDRESS>'' AND id = ' || event_id AS text, 'ok' AS status FROM events")


@register("chat_anonymize", "SELECT conv_id, turn, role, coalesce(text, '') || ' <EMAIL_ADDRESS>' AS text FROM conversations")
def chat_anonymize(spark: SparkSession, d: str) -> DataFrame:
    added = F.concat(F.coalesce("text", F.lit("")), F.lit(" u"), F.col("conv_id").cast("string"), F.lit("@example.com"))
    rows = _table(spark, d, "conversations").select("conv_id", "turn", "role", added.alias("text"))
    return rows.withColumn("text", native.splice(F.col("text"), native.spans(F.col("text"), *SHAPES["email"]), native.custom("<{entity_type}>")))


@register("strip_diacritics")
def strip_diacritics(spark: SparkSession, d: str) -> DataFrame:
    scan.importable(spark)
    return _table(spark, d, "documents").select("doc_id", pandas_udf(lambda s: s.map(lambda t: None if t is None else strip_marks(t)), "string")("text").alias("plain"))


@register("collapse_newlines", r"SELECT doc_id, regexp_replace(text, '[ \t\f\r\n]*\n[ \t\f\r\n]*', ' ', 'g') AS flat FROM documents")
def collapse_newlines(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"[ \t\f\r\n]*\n[ \t\f\r\n]*", " ").alias("flat"))


@register("normalized_view", "SELECT c_custkey, 'u' || c_custkey || '@x.org A+ %zz ' || chr(233) AS view FROM customer")
def normalized_view(spark: SparkSession, d: str) -> DataFrame:
    scan.importable(spark)
    t = F.concat(F.lit("ｕ"), F.col("c_custkey").cast("string"), F.lit("%40x.org \\u0041+ %zz é"))
    return _table(spark, d, "customer").select("c_custkey", pandas_udf(lambda s: s.map(lambda x: normalized(x).text), "string")(t).alias("view"))


@register("catalogue")
def catalogue(spark: SparkSession, d: str) -> DataFrame:
    return registry.catalogue(spark)


_CASES = "SELECT doc_id AS case_id, CASE WHEN doc_id % 2 = 0 THEN 'contract' ELSE 'challenge' END AS tier, source AS category FROM documents"


@register("eval_metrics", f"""WITH p AS ({_sql_spans("email")} UNION ALL {_sql_spans("ipv4")}), x AS (SELECT * FROM p WHERE "start" % 3 <> 0 OR entity_type = 'EMAIL_ADDRESS'), y AS (SELECT * FROM p WHERE "start" % 5 <> 0),
  o AS (SELECT coalesce(x.doc_id, y.doc_id) AS case_id, coalesce(x.entity_type, y.entity_type) AS entity_type, (x.doc_id IS NOT NULL AND y.doc_id IS NOT NULL)::INT AS tp, (x.doc_id IS NULL)::INT AS fp, (y.doc_id IS NULL)::INT AS fn
    FROM x FULL JOIN y ON x.doc_id = y.doc_id AND x.entity_type = y.entity_type AND x."start" = y."start"), j AS (SELECT * FROM o JOIN ({_CASES}) USING (case_id))
  SELECT CASE WHEN grouping(tier) = 0 THEN 'tier' WHEN grouping(category) = 0 THEN 'category' WHEN grouping(entity_type) = 0 THEN 'entity_type' ELSE 'all' END AS level, coalesce(tier, category, entity_type, '') AS value,
    CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(CASE WHEN sum(tp) + sum(fp) > 0 THEN (sum(tp) * 1000000) // (sum(tp) + sum(fp)) END AS BIGINT) AS precision_ppm, CAST(CASE WHEN sum(tp) + sum(fn) > 0 THEN (sum(tp) * 1000000) // (sum(tp) + sum(fn)) END AS BIGINT) AS recall_ppm
  FROM j GROUP BY GROUPING SETS ((), (tier), (category), (entity_type))""")
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    p = _spark_spans(docs, "email").unionByName(_spark_spans(docs, "ipv4")).withColumnRenamed("doc_id", "case_id")
    result = evaluate.outcomes(p.where("start % 3 <> 0 OR entity_type = 'EMAIL_ADDRESS'"), p.where("start % 5 <> 0"))
    cases = docs.select(F.col("doc_id").alias("case_id"), F.when(F.col("doc_id") % 2 == 0, "contract").otherwise("challenge").alias("tier"), F.col("source").alias("category"))
    return evaluate.metrics(result, cases)


@register("eval_gates", "SELECT 'entity_type' AS level, 'NO_SUCH' AS value WHERE true")
def eval_gates(spark: SparkSession, d: str) -> DataFrame:
    found = eval_metrics(spark, d).where("level = 'entity_type'")
    gates = found.select("level", "value", F.col("tp").alias("min_tp"), F.col("fp").alias("max_fp"), F.col("fn").alias("max_fn")).union(spark.sql("SELECT 'entity_type', 'NO_SUCH', 1L, 0L, 0L"))
    return evaluate.gate_failures(found, gates).select("level", "value")


def _words(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("l_linenumber")
    return _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").cast("long").alias("word_idx"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"), (i % 3 * 50.0).alias("x"), (700.0 - F.floor(i / 3) * 20.0).alias("y"), F.lit(40.0).alias("width"), F.lit(12.0).alias("height"))


_WORDS_SQL = "SELECT l_orderkey AS doc_id, l_linenumber AS i, 'w' || l_partkey AS text, l_linenumber % 3 * 50.0 AS x, 700.0 - floor(l_linenumber / 3) * 20.0 AS y FROM lineitem"


@register("layout_lines", f"SELECT doc_id, 1 AS page, string_agg(t, chr(10) ORDER BY y DESC) AS text FROM (SELECT doc_id, y, string_agg(text, ' ' ORDER BY x, i, text) AS t FROM ({_WORDS_SQL}) GROUP BY doc_id, y) GROUP BY doc_id")
def layout_lines(spark: SparkSession, d: str) -> DataFrame:
    return layout.page_text(layout.lines(_words(spark, d)))


@register("region_bbox", f"SELECT doc_id, 1 AS page, CAST(min(x) - least(2.0, min(x)) AS DOUBLE) AS x0, CAST(min(y) - 2.0 AS DOUBLE) AS y0, CAST(max(x) + 42.0 AS DOUBLE) AS x1, CAST(max(y) + 14.0 AS DOUBLE) AS y1 FROM ({_WORDS_SQL}) GROUP BY doc_id")
def region_bbox(spark: SparkSession, d: str) -> DataFrame:
    lined = layout.lines(_words(spark, d))
    whole = lined.groupBy("doc_id", "page").agg(F.min("start").alias("start"), F.max("end").alias("end")).withColumn("entity_type", F.lit("ALL"))
    return layout.regions(lined, whole, 2.0).select("doc_id", "page", "x0", "y0", "x1", "y1")
