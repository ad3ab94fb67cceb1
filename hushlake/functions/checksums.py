"""Value predicates as Catalyst expressions, and the same rules as DuckDB SQL for the oracles.

A weighted checksum is a sum of digit times weight; ``rule`` says what the sum
must be. Both engines get the rule from one table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: name: digits, weights, condition on the sum s, with d1 as the first digit and so on.
RULES: dict[str, tuple[int, tuple[int, ...], str]] = {
    "aba": (9, (3, 7, 1, 3, 7, 1, 3, 7, 1), "s % 10 = 0 AND (d1 * 10 + d2 BETWEEN 1 AND 12 OR d1 * 10 + d2 BETWEEN 21 AND 32 OR d1 * 10 + d2 BETWEEN 61 AND 72 OR d1 * 10 + d2 = 80)"),
    "nhs": (10, (10, 9, 8, 7, 6, 5, 4, 3, 2), "(11 - s % 11) % 11 = d10"),
    "abn": (11, (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19), "(s - 10) % 89 = 0"),
    "acn": (9, (8, 7, 6, 5, 4, 3, 2, 1), "(10 - s % 10) % 10 = d9"),
    "tfn": (9, (1, 4, 3, 7, 5, 8, 6, 9, 10), "s % 11 = 0"),
    "medicare": (10, (1, 3, 7, 9, 1, 3, 7, 9), "s % 10 = d9"),
    "rrn": (13, (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5), "d7 BETWEEN 1 AND 4 AND (11 - s % 11) % 10 = d13"),
    "frn": (13, (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5), "d7 BETWEEN 5 AND 8 AND (11 - s % 11) % 10 = d13"),
    "brn": (10, (1, 3, 7, 1, 3, 7, 1, 3, 5), "(10 - (s + CAST(floor(d9 * 5 / 10) AS INT)) % 10) % 10 = d10"),
    "pesel": (11, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3), "(10 - s % 10) % 10 = d11"),
    "emso": (13, (7, 6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2), "d8 = 5 AND (11 - s % 11) % 11 = d13"),
    "si_tax": (8, (8, 7, 6, 5, 4, 3, 2), "d1 <> 0 AND s % 11 <> 0 AND (11 - s % 11) % 10 = d8"),
    "tnin": (13, (13, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2), "(11 - s % 11) % 10 = d13"),
    "ssn": (9, (0,), "d1 <> 9 AND NOT (d1 = 0 AND d2 = 0 AND d3 = 0) AND NOT (d1 = 6 AND d2 = 6 AND d3 = 6) AND d4 + d5 > 0 AND d6 + d7 + d8 + d9 > 0"),
    "itin": (9, (0,), "d1 = 9 AND (d4 * 10 + d5 BETWEEN 50 AND 65 OR d4 * 10 + d5 BETWEEN 70 AND 88 OR d4 * 10 + d5 BETWEEN 90 AND 92 OR d4 * 10 + d5 BETWEEN 94 AND 99)"),
    "gstin_state": (2, (0,), "d1 * 10 + d2 BETWEEN 1 AND 37 OR d1 * 10 + d2 = 97"),
}


def rule_sql(name: str, value: str) -> str:
    """Boolean SQL, the same in Spark and DuckDB, of whether the digits of string ``value`` obey a rule; ``value`` must have no other characters."""
    n, weights, condition = RULES[name]
    d = lambda i: f"CAST(substr({value}, {i}, 1) AS INT)"
    total = "(" + " + ".join(f"{w} * {d(i)}" for i, w in enumerate(weights, 1) if w) + ")" if any(weights) else "0"
    for i in range(13, 0, -1):
        condition = condition.replace(f"d{i}", d(i))
    condition = re.sub(r"\bs\b", lambda _: total, condition)
    return f"(CASE WHEN length({value}) = {n} THEN ({condition}) ELSE FALSE END)"


def rule(name: str, text: Column) -> Column:
    """Whether a text's digits obey a rule; other characters don't count."""
    n = RULES[name][0]
    return F.when(F.length(F.regexp_replace(text, "[^0-9]", "")) == n, _checked(name, F.regexp_replace(text, "[^0-9]", ""))).otherwise(False)


def _checked(name: str, value: Column) -> Column:
    return F.transform(F.array(value), lambda v: F.call_function("coalesce", _expr(name, v), F.lit(False)))[0]


def _expr(name: str, v: Column) -> Column:
    n, weights, _ = RULES[name]
    d = [F.substring(v, i, 1).cast("int") for i in range(1, n + 1)]
    s = sum((w * x for w, x in zip(weights, d)), F.lit(0))
    two = lambda i: d[i - 1] * 10 + d[i]
    return {
        "aba": lambda: (s % 10 == 0) & (two(1).between(1, 12) | two(1).between(21, 32) | two(1).between(61, 72) | (two(1) == 80)),
        "nhs": lambda: (11 - s % 11) % 11 == d[9],
        "abn": lambda: (s - 10) % 89 == 0,
        "acn": lambda: (10 - s % 10) % 10 == d[8],
        "tfn": lambda: s % 11 == 0,
        "medicare": lambda: s % 10 == d[8],
        "rrn": lambda: d[6].between(1, 4) & ((11 - s % 11) % 10 == d[12]),
        "frn": lambda: d[6].between(5, 8) & ((11 - s % 11) % 10 == d[12]),
        "brn": lambda: (10 - (s + F.floor(d[8] * 5 / 10)) % 10) % 10 == d[9],
        "pesel": lambda: (10 - s % 10) % 10 == d[10],
        "emso": lambda: (d[7] == 5) & ((11 - s % 11) % 11 == d[12]),
        "si_tax": lambda: (d[0] != 0) & (s % 11 != 0) & ((11 - s % 11) % 10 == d[7]),
        "tnin": lambda: (11 - s % 11) % 10 == d[12],
        "ssn": lambda: (d[0] != 9) & ~F.substring(v, 1, 3).isin("000", "666") & (F.substring(v, 4, 2) != "00") & (F.substring(v, 6, 4) != "0000"),
        "itin": lambda: (d[0] == 9) & (two(4).between(50, 65) | two(4).between(70, 88) | two(4).between(90, 92) | two(4).between(94, 99)),
        "gstin_state": lambda: two(1).between(1, 37) | (two(1) == 97),
    }[name]()


def luhn(text: Column) -> Column:
    """The Luhn check on 13 digits or more, whatever stands between them."""
    d = F.regexp_replace(text, "[^0-9]", "")
    return (F.length(d) >= 13) & F.call_function("luhn_check", d)


def iban(text: Column) -> Column:
    """mod 97 of the rotated value, letters as 10 to 35, is 1."""
    a = F.upper(F.regexp_replace(text, "[^0-9A-Za-z]", ""))
    r = F.concat(F.substr(a, F.lit(5)), F.substring(a, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    mod = F.aggregate(F.filter(F.split(r, ""), lambda c: c != ""), F.lit(0), lambda s, c: (s * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97)
    return (F.length(a) >= 5) & (mod == 1)
