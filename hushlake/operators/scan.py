"""The whole-registry scan: one Arrow UDF from text to spans, and its pure-Python core."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from hushlake.functions.normalize import View, byte_offsets, normalized
from hushlake.functions.validators import BY_TYPE
from hushlake.operators import names
from hushlake.plans.registry import CONTEXT_BOOST, CONTEXT_WINDOW, MAX_BYTES, Recogniser, built_in, prune

SPANS = "array<struct<entity_type:string,original:string,start:int,end:int,score:double,replaced:boolean>>"
_MULTILINE = ("CREDIT_CARD", "FR_IBAN")


@dataclass(frozen=True)
class Settings:
    """What a scan is run with. ``crew_blocklist`` holds three-letter words that are no crew codes, in capitals."""

    threshold: float = 0.5
    boost: float = CONTEXT_BOOST
    least_with_context: float = 0.0
    recognisers: tuple[Recogniser, ...] = field(default_factory=lambda: tuple(built_in()))
    crew_blocklist: frozenset[str] = frozenset("THE AND FOR NOT YOU ALL CAN HAD HER WAS ONE OUR OUT ARE BUT HIS HAS NEW NOW SEE WHO GET LET PUT SAY SHE USE DAY END MAY SET TRY RUN ANY TOP YET HOW ITS TWO YES LOW URL API SQL CSV PDF XML USB DNS SSN NHS VAT TAX".split())
    names: names.NameLists | None = None


@dataclass(frozen=True)
class Span:
    entity_type: str
    start: int
    end: int
    score: float
    replaced: bool = True


_compiled: dict[str, regex.Pattern] = {}


def _pattern(r: Recogniser) -> regex.Pattern:
    if r.pattern not in _compiled:
        _compiled[r.pattern] = regex.compile(r.pattern)
    return _compiled[r.pattern]


def in_context(text: str, start: int, end: int, keywords: tuple[str, ...]) -> bool:
    """A keyword within 80 characters, or in the same byte column of one of the 20 lines above."""
    near = text[max(0, start - CONTEXT_WINDOW) : end + CONTEXT_WINDOW].lower()
    if any(k in near for k in keywords):
        return True
    line = text.rfind("\n", 0, start) + 1
    if not line:
        return False
    column = len(text[line:start].encode())
    for above in text[: line - 1].split("\n")[-20:]:
        low = above.lower()
        for k in keywords:
            at = low.find(k)
            if at >= 0:
                a = len(low[:at].encode())
                if a <= column + 4 and column <= a + len(k.encode()) + 4:
                    return True
    return False


#: Patterns that can match without a digit, each with a string that all of its matches hold.
_WITHOUT_DIGIT = {"email": "@", "url": "://", "ipv6": ":", "mac_colon": ":", "mac_hyphen": "-", "mac_cisco": ".", "job_title_role": "", "job_title_csuite": "", "aircraft_fr": "F-", "aircraft_eu": "-", "crew_code": "", "uuid": "-", "crypto_bitcoin": "1", "jwt": "eyJ", "openai_key": "sk-", "slack_token": "xox", "private_key": "PRIVATE KEY", "connection_string": "://"}
_SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token")
_BUILT_IN = frozenset((r.name, r.pattern) for r in built_in())
_DIGIT = regex.compile(r"\d")


_ALWAYS, _DIGITS, _MARKED_DIGITS, _ASSIGNED = range(4)
_LONG_RUN, _THREE_CAPITALS = regex.compile(r"[0-9A-Za-z]{16}"), regex.compile(r"[A-Z]{3}")
#: What a text needs, beside a digit or a string, for any match of these patterns; each is tried once for a text.
_NEEDS: dict[str, Callable[[str, str], bool]] = {
    "colons": lambda text, low: "::" in text or text.count(":") >= 7,
    "pairs": lambda text, low: text.count(":") >= 5 or text.count("-") >= 5,
    "dots": lambda text, low: text.count(".") >= 2,
    "hyphens": lambda text, low: text.count("-") >= 4,
    "run": lambda text, low: _LONG_RUN.search(text) is not None,
    "capitals": lambda text, low: _THREE_CAPITALS.search(text) is not None,
    "extension": lambda text, low: "poste" in low or "ext" in low,
}
_NEED_OF = {"ipv6": "colons", "mac_colon": "pairs", "mac_hyphen": "pairs", "mac_cisco": "dots", "uuid": "hyphens", "crypto_bitcoin": "run", "crypto_ethereum": "run", "it_fiscal_code": "run", "crew_code": "capitals", "aircraft_eu": "capitals", "phone_extension": "extension"}


class Gated:
    """Recognisers with what each needs of a text to hit at all."""

    def __init__(self, use: list[Recogniser]) -> None:
        self.use, self.gates = use, []
        for r in use:
            kind, held, need = _ALWAYS, "", None
            if (r.name, r.pattern) in _BUILT_IN:
                need = _NEED_OF.get(r.name)
                if r.name == "assignment":
                    kind = _ASSIGNED
                elif r.name in _WITHOUT_DIGIT:
                    held = _WITHOUT_DIGIT[r.name]
                else:
                    kind = _MARKED_DIGITS if r.name in ("github_token", "github_fine_grained", "aws_access_key", "stripe_key") else _DIGITS
            self.gates.append((r, frozenset(r.keywords) if r.required else frozenset(), kind, held, need))
        self.keywords = sorted({k for _, keys, *_ in self.gates for k in keys})


@dataclass(frozen=True)
class _Plan:
    """What a settings' recognisers come to, made once."""

    whole: Gated
    over_lines: Gated
    in_urls: Gated


_plans: dict[int, tuple[Settings, _Plan]] = {}


def _plan(s: Settings) -> _Plan:
    if id(s) not in _plans or _plans[id(s)][0] is not s:
        use = prune(list(s.recognisers), s.threshold, s.boost)
        if len(_plans) > 64:
            _plans.clear()
        _plans[id(s)] = s, _Plan(Gated(use), Gated([r for r in use if r.entity_type in _MULTILINE]), Gated([r for r in use if r.entity_type != "URL"]))
    return _plans[id(s)][1]


def possible(use: Gated, text: str) -> list[Recogniser]:
    """Those that may hit: a gating keyword somewhere, and a character or string that every match needs."""
    low, digit = text.lower(), _DIGIT.search(text) is not None
    present = {k for k in use.keywords if k in low}
    allowed = {_ALWAYS: True, _DIGITS: digit, _MARKED_DIGITS: digit or any(x in text for x in ("gh", "AKIA", "ASIA", "k_")), _ASSIGNED: any(w in low for w in _SECRET_WORDS)}
    met = {None: True} | {name: f(text, low) for name, f in _NEEDS.items()}
    return [r for r, keys, kind, held, need in use.gates if allowed[kind] and met[need] and (not keys or not keys.isdisjoint(present)) and held in text]


def _hits(view: View, about: str, use: Gated, s: Settings) -> Iterator[tuple[Recogniser, int, int, float]]:
    """Pattern hits that pass context, value and threshold, in the view's places."""
    text = view.text
    # Where the text isn't what keywords are looked for in, nothing is ruled out by it.
    for r in possible(use, text) if about is text else use.use:
        for m in _pattern(r).finditer(text):
            a, b = m.span()
            if a == b:
                continue
            near = bool(r.keywords) and in_context(about if about is not text else text, a, b, r.keywords)
            if r.required and r.keywords and not near:
                continue
            if r.entity_type == "CREW_CODE" and m[0] in s.crew_blocklist:
                continue
            if r.entity_type in BY_TYPE and not BY_TYPE[r.entity_type](m[0]):
                continue
            boosted = near and not r.required
            score = min(r.score + s.boost, 1.0) if boosted else r.score
            if score < s.threshold or boosted and s.least_with_context > 0 and score < s.least_with_context:
                continue
            yield r, a, b, score


def resolve(spans: list[Span]) -> list[Span]:
    """Earliest start wins, then the longest, then the surest, then by name; nothing that overlaps a kept span stays."""
    kept, end = [], 0
    for x in sorted(spans, key=lambda x: (x.start, x.start - x.end, -x.score, x.entity_type)):
        if not kept or x.start >= end:
            kept.append(x)
            end = x.end
    return kept


def detect(text: str, s: Settings, people: Callable[[str], list[tuple[int, int, float]]] | None = None) -> list[Span]:
    """Spans of a text in characters. Inner hits of URLs come last and are only reported."""
    plan = _plan(s)
    view = normalized(text)
    digit = lambda i: 0 <= i < len(view.text) and "0" <= view.text[i] <= "9"
    found = [Span(r.entity_type, *view.source(a, b), score) for r, a, b, score in _hits(view, view.text, plan.whole, s) if r.entity_type != "FR_SSN" or not (digit(a - 1) or digit(b))]
    flat = View(view.text).one_line()
    if flat is not None:
        for r, a, b, score in _hits(flat, flat.text, plan.over_lines, s):
            x, y = flat.source(a, b)
            if "\n" in view.text[x:y]:
                found.append(Span(r.entity_type, *view.source(x, y), score))
    people = people or ((lambda t: names.heuristic(t, s.names, s.crew_blocklist)) if s.names else None)
    for a, b, score in people(text) if people else []:
        if score >= s.threshold and text[a:b].strip().lower() not in names.BLOCKED:
            found.append(Span("PERSON", a, names.extend(text, a, b, s.crew_blocklist), score))
    covered = lambda a, b: any(x.start <= a and x.end >= b for x in found)
    for a, b in names.sign_offs(text):
        if not covered(a, b):
            found.append(Span("PERSON", a, b, 0.60))
    for a, b in names.consistent(text, [text[x.start : x.end] for x in found if x.entity_type == "PERSON" and " " in text[x.start : x.end]]):
        if not covered(a, b):
            found.append(Span("PERSON", a, b, 0.50))
    others = [x for x in found if x.entity_type != "PASSWORD"]
    found = [x for x in found if x.entity_type != "PASSWORD" or not any(x.start <= o.start and o.end <= x.end for o in others)]
    kept = resolve(found)
    return kept + _within_urls(text, kept, plan.in_urls, s)


def _within_urls(text: str, kept: list[Span], use: Gated, s: Settings) -> list[Span]:
    inner = []
    for u in (x for x in kept if x.entity_type == "URL"):
        url, here = text[u.start : u.end], []
        for m in regex.finditer(r"(?<=[?&][^=&#?]*=)[^&#]+", url):
            view = normalized(m[0])
            for r, a, b, score in _hits(view, url, use, s):
                x, y = view.source(a, b)
                here.append(Span(r.entity_type, u.start + m.start() + x, u.start + m.start() + y, score, False))
        inner += resolve(here)
    return inner


def as_rows(text: str | None, s: Settings) -> list[tuple]:
    """Span rows with byte offsets; nothing for null."""
    if not text:
        return []
    at = byte_offsets(text)
    return [(x.entity_type, text[x.start : x.end], at[x.start], at[x.end], x.score, x.replaced) for x in detect(text, s)]


def importable(spark: SparkSession) -> None:
    """Let Python workers import this library where only the driver has it on its path."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def spans(text: Column, settings: Settings | None = None) -> Column:
    """Column of SPANS for a text column: narrow, no shuffle; the registry travels once with the function."""
    s = settings or Settings()

    @pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("entity_type", "original", "start", "end", "score", "replaced"), r)) for r in as_rows(t, s)] for t in texts])

    return run(text)




def detections(df: DataFrame, text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """The input with ``spans`` and ``status`` (ok or too_large); texts over 50 MiB aren't scanned."""
    importable(df.sparkSession)
    fits = F.octet_length(text_col) <= MAX_BYTES
    return df.withColumn("spans", spans(F.when(fits, F.col(text_col)), settings)).withColumn("status", F.when(F.coalesce(fits, F.lit(True)), "ok").otherwise("too_large"))


def exploded(df: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each span. A text that was too large to scan stops the job, as it would come out as one without any."""
    refused = F.raise_error(F.lit("a text of more than 50 MiB can't be scanned")).cast(SPANS)
    return df.select(*keep, F.inline(F.when(F.col("status") == "ok", F.col("spans")).otherwise(refused)))


__all__ = ["SPANS", "Settings", "Span", "as_rows", "detect", "detections", "exploded", "replace", "resolve", "spans"]
