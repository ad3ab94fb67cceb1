"""One recogniser without Python: spans with byte offsets, overlap resolution, replacement, tokens, all in Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shapes that both Java's and DuckDB's engine read alike.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IPV4 = r"(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
CARD = r"(?:[0-9]{4}[ -]?){3}[0-9]{4}"
PHONE = r"\+[1-9][0-9]{0,2} ?(?:\([0-9]{1,4}\) ?)?(?:[0-9][ .-]?){6,14}[0-9]"
URL = r"https?://[^\s\)\]>\"']+[^\s\)\]>\"'.,;:!?]"


def spans(text: Column, pattern: str, entity_type: str, score: float) -> Column:
    """array<struct<entity_type, original, start, end, score>> with UTF-8 byte offsets; the pattern has no groups and no empty match."""
    found, gaps = F.regexp_extract_all(text, F.lit(f"({pattern})")), F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<entity_type:string,original:string,start:int,end:int,score:double>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.octet_length(x["gap"])
        end = start + F.octet_length(x["hit"])
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(F.lit(entity_type).alias("entity_type"), x["hit"].alias("original"), start.alias("start"), end.alias("end"), F.lit(score).alias("score")))).alias("out"))

    pairs = F.arrays_zip(found.alias("hit"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"))
    return F.when(text.rlike(pattern), F.aggregate(pairs, zero, step)["out"]).otherwise(zero["out"])


def resolve(found: Column) -> Column:
    """Greedy overlap resolution: earliest start, then longest, surest, first by name."""
    keyed = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("s"), (-x["end"]).alias("n"), (-x["score"]).alias("p"), x["entity_type"].alias("t"), x.alias("x"))))
    zero = F.struct(F.lit(0).alias("end"), F.filter(found, lambda _: F.lit(False)).alias("out"))
    fits = lambda a, k: k["x"]["start"] >= a["end"]
    return F.aggregate(keyed, zero, lambda a, k: F.struct(F.when(fits(a, k), k["x"]["end"]).otherwise(a["end"]).alias("end"), F.when(fits(a, k), F.concat(a["out"], F.array(k["x"]))).otherwise(a["out"]).alias("out")))["out"]


def splice(text: Column, found: Column, put: Callable[[Column], Column]) -> Column:
    """The text with each span, in order and apart from the others, replaced by ``put(span)``; bytes are counted, not characters."""
    raw = F.encode(text, "utf-8")
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(found, zero, lambda s, x: F.struct(F.concat(s["out"], _between(raw, s["at"], x["start"]), put(x)).alias("out"), x["end"].alias("at")))
    return F.concat(done["out"], _between(raw, done["at"], F.octet_length(text)))


def _between(raw: Column, start: Column, end: Column) -> Column:
    return F.substr(raw, start + 1, end - start).cast("string")


def redact(x: Column) -> Column:
    return F.lit("")


def mask(char: str = "*", count: int | None = None, from_end: bool = False) -> Callable[[Column], Column]:
    """Characters replaced, all or ``count`` of them from one end; never longer than the value."""

    def put(x: Column) -> Column:
        o = x["original"]
        n = F.length(o) if count is None else F.least(F.lit(count), F.length(o))
        dots = F.repeat(F.lit(char), n)
        return F.concat(F.substr(o, F.lit(1), F.length(o) - n), dots) if from_end else F.concat(dots, F.substr(o, n + 1))

    return put


def hashed(kind: str = "sha256") -> Callable[[Column], Column]:
    return {"sha256": lambda x: F.sha2(x["original"], 256), "sha512": lambda x: F.sha2(x["original"], 512), "md5": lambda x: F.md5(x["original"])}[kind]


def custom(template: str) -> Callable[[Column], Column]:
    return lambda x: F.replace(F.lit(template), F.lit("{entity_type}"), x["entity_type"])


def encrypt(key_hex: str) -> Callable[[Column], Column]:
    """``ENC[hex of IV and ciphertext]`` by AES-CBC with a random IV."""
    if len(key_hex) not in (32, 48, 64):
        raise ValueError("a key has 32, 48 or 64 hex digits")
    return lambda x: F.concat(F.lit("ENC["), F.lower(F.hex(F.aes_encrypt(x["original"], F.unhex(F.lit(key_hex)), F.lit("CBC"), F.lit("PKCS")))), F.lit("]"))


def decrypt(text: Column, key_hex: str) -> Column:
    """Every ``ENC[...]`` that decrypts, restored; others stay."""
    pattern = r"ENC\[[0-9a-f]{64,}\]"
    opened = lambda x: F.try_aes_decrypt(F.unhex(F.regexp_extract(x["original"], r"([0-9a-f]+)", 1)), F.unhex(F.lit(key_hex)), F.lit("CBC"), F.lit("PKCS")).cast("string")
    return splice(text, spans(text, pattern, "ENC", 1.0), lambda x: F.coalesce(opened(x), x["original"]))


def per_entity(operators: dict[str, Callable[[Column], Column]]) -> Callable[[Column], Column]:
    """The operator of a span's type, else DEFAULT, else keep."""

    def put(x: Column) -> Column:
        out = operators.get("DEFAULT", lambda y: y["original"])(x)
        for entity, f in operators.items():
            if entity != "DEFAULT":
                out = F.when(x["entity_type"] == entity, f(x)).otherwise(out)
        return out

    return put


def apply_spans(df: DataFrame, text_col: str, spans_col: str, operators: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Operators on spans that a caller brings: ``result`` and ``status`` (ok, overlapping or out_of_range; the text stays as it is then)."""
    ordered = F.array_sort(F.transform(spans_col, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["entity_type"].alias("entity_type"), x["original"].alias("original"))))
    out = df.withColumn("ordered spans", ordered)
    apart = F.aggregate("ordered spans", F.struct(F.lit(0).alias("end"), F.lit(True).alias("ok")), lambda a, x: F.struct(x["end"].alias("end"), (a["ok"] & (x["start"] >= a["end"])).alias("ok")))["ok"]
    inside = F.forall("ordered spans", lambda x: (x["start"] >= 0) & (x["start"] <= x["end"]) & (x["end"] <= F.octet_length(text_col)))
    status = F.when(~inside, "out_of_range").when(~apart, "overlapping").otherwise("ok")
    return out.withColumn("status", status).withColumn("result", F.when(F.col("status") == "ok", splice(F.col(text_col), F.col("ordered spans"), per_entity(operators))).otherwise(F.col(text_col))).drop("ordered spans")


def token_of(session: str, entity_type: Column, original: Column, attempt: Column, digits: int = 8) -> Column:
    """``[TYPE_hhhhhhhh]`` from a keyed digest: the same in every task and retry."""
    return F.concat(F.lit("["), entity_type, F.lit("_"), F.substring(F.sha2(F.concat_ws("\u0001", F.lit(session), entity_type, original, attempt.cast("string")), 256), 1, digits), F.lit("]"))


def mapping(detected: DataFrame, session: str, digits: int = 8) -> DataFrame:
    """``(session_id, token, entity_type, original)`` of distinct values (entity_type, original).

    Values whose tokens collide are hashed again with their rank among them, a
    shuffle on the token only; collisions of the second round are a matter of
    2**-32 of 2**-32 and stop the job. Texts get their tokens from this table
    (``tokenized``), never from a digest of their own.
    """
    values = detected.select("entity_type", "original").distinct()
    of = lambda attempt: token_of(session, F.col("entity_type"), F.col("original"), attempt, digits)
    rank = F.row_number().over(Window.partitionBy("token").orderBy("entity_type", "original")) - 1
    again = values.withColumn("token", of(F.lit(0))).withColumn("attempt", rank).withColumn("token", F.when(F.col("attempt") > 0, of(F.col("attempt"))).otherwise(F.col("token")))
    once = F.count("*").over(Window.partitionBy("token"))
    return again.withColumn("times", once).select(F.lit(session).alias("session_id"), F.when(F.col("times") == 1, F.col("token")).otherwise(F.raise_error(F.lit("token collision")).cast("string")).alias("token"), "entity_type", "original")


def tokenized(df: DataFrame, spans_col: str, table: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``(key, text)`` with each span replaced by the token that the mapping has for its value; a value that it hasn't stops the job.

    A row's distinct values go to the mapping by an equi-join and come back by
    the row's key, which must be unique; the texts move once.
    """
    value = F.struct("entity_type", "original")
    asked = df.select(key, F.explode(F.array_distinct(F.transform(spans_col, lambda x: F.struct(x["entity_type"].alias("entity_type"), x["original"].alias("original"))))).alias("v")).select(key, "v.*")
    given = asked.join(table.select("entity_type", "original", "token"), ["entity_type", "original"]).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(value.alias("k"), "token"))).alias("tokens"))
    missing = F.raise_error(F.lit("a value without a token")).cast("string")
    put = lambda x: F.coalesce(F.element_at("tokens", F.struct(x["entity_type"].alias("entity_type"), x["original"].alias("original"))), missing)
    with_tokens = df.select(key, F.col(text_col).alias("text"), F.col(spans_col).alias("found")).join(given, key, "left")
    return with_tokens.select(key, F.when(F.col("tokens").isNull(), F.col("text")).otherwise(splice(F.col("text"), F.col("found"), put)).alias("text"))


#: Parts that a session's entries are ranked in before its newest are chosen.
EVICT_PARTS = 64


def evict(table: DataFrame, most: int, order: str = "first_seen") -> DataFrame:
    """The ``most`` newest entries of each session. Each part of a session is cut to so many first, so no task sorts a whole session."""
    newest = [F.desc(order), F.desc("token")]
    parted = table.withColumn("part", F.pmod(F.hash("token"), F.lit(EVICT_PARTS)))
    few = parted.withColumn("age", F.row_number().over(Window.partitionBy("session_id", "part").orderBy(*newest))).where(F.col("age") <= most)
    return few.withColumn("age", F.row_number().over(Window.partitionBy("session_id").orderBy(*newest))).where(F.col("age") <= most).drop("age", "part")


def evicted_count(table: DataFrame, most: int) -> DataFrame:
    """``(session_id, entries, evicted)``: how many entries of each session a mapping of ``most`` has dropped."""
    return table.groupBy("session_id").agg(F.count("*").alias("entries")).withColumn("evicted", F.greatest(F.col("entries") - most, F.lit(0).cast("long")))


def integrity(table: DataFrame) -> DataFrame:
    """A digest over all entries that doesn't depend on their order: detects damage, proves nothing about the writer."""
    each = F.sha2(F.to_json(F.struct("session_id", "token", "original")), 256)
    return table.select(each.alias("d")).agg(F.count("*").alias("entries"), F.sha2(F.concat_ws(",", F.bit_xor(F.xxhash64("d")), F.sum(F.xxhash64("d").cast("decimal(38,0)"))), 256).alias("digest"))


TOKEN = r"\[[A-Z][A-Z0-9_]*_[0-9a-f]{8}\]"


#: A token without its brackets, with no letter or digit beside it.
BARE = r"(?<![0-9A-Za-z])[A-Z][A-Z0-9_]*_[0-9a-f]{8}(?![0-9A-Za-z])"


def restore(df: DataFrame, table: DataFrame, key: str, text_col: str = "text", bare: bool = False) -> DataFrame:
    """``(key, restored)``: known tokens as their originals, others as they are.

    Each row's tokens go to the mapping by an equi-join on the token and come
    back by the row's key, so the mapping is never on one machine. Restored text
    isn't read again, but with ``bare``, where tokens without brackets are
    restored in a second pass.
    """
    done = _restored(df, table.select("token", "original"), key, text_col, TOKEN)
    if not bare:
        return done
    return _restored(done, table.select(F.regexp_replace("token", r"[\[\]]", "").alias("token"), "original"), key, "restored", BARE)


def _restored(df: DataFrame, table: DataFrame, key: str, text_col: str, pattern: str) -> DataFrame:
    cut = df.select(key, F.col(text_col).alias("t"), F.regexp_extract_all(text_col, F.lit(f"({pattern})")).alias("found"))
    known = cut.select(key, F.explode(F.array_distinct("found")).alias("token")).join(table.select("token", F.col("original").alias("value of it")), "token")
    known = known.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "value of it"))).alias("known"))
    gaps = F.split(F.col("t"), pattern, -1)
    put = F.transform(F.arrays_zip(gaps.alias("g"), F.col("found").alias("f")), lambda x: F.concat(x["g"], F.coalesce(F.element_at("known", x["f"]), x["f"], F.lit(""))))
    return cut.join(known, key, "left").select(key, F.when(F.col("known").isNull(), F.col("t")).otherwise(F.array_join(put, "")).alias("restored"))
