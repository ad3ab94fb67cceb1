import itertools
import random
import re
from re import _parser

from hushlake.llm import license


def samples(regex):
    """Texts of all branches of a regex, with and without its optional parts."""

    def of(tokens):
        return ["".join(x) for x in itertools.islice(itertools.product(*[one(*t) for t in tokens]), 40)]

    def one(op, arg):
        name = str(op)
        if name == "LITERAL":
            return [chr(arg)]
        if name == "NOT_LITERAL":
            return ["q"]
        if name == "IN":
            kind, first = arg[0]
            return ["q"] if str(kind) == "NEGATE" else [chr(first if str(kind) == "LITERAL" else first[0])]
        if name == "BRANCH":
            return [x for branch in arg[1] for x in of(branch)]
        if name == "SUBPATTERN":
            return of(arg[3])
        if name == "MAX_REPEAT":
            low, high, inner = arg
            return [x * n for n in sorted({low, min(low + 1, high)}) for x in of(inner)]
        raise AssertionError(name)

    return sorted(set(of(_parser.parse(regex))))


def hinted(text):
    return any(h in text for h in license.HINTS if h != "cc") or bool(re.search(r"(?:^|[^a-z0-9])cc(?:0|[^a-z0-9])", text))


def test_every_alternative_has_its_rules_keyword_and_a_hint():
    for rule in license.rules():
        for text in samples(rule["regex"]):
            words = text.split()
            assert rule["keyword"] in words, (rule["label"], rule["keyword"], text)
            assert hinted(text), (rule["label"], text)


def test_every_hand_written_rule_fires_alone(spark):
    rules = [r for r in license.rules() if r["priority"] < 30]
    rows = [(r["rule"], r["label"], samples(r["regex"])[0]) for r in rules]
    got = {x.doc_id: x.labels.split(",") for x in license.summary(spark.createDataFrame(rows, "doc_id int, label string, text string")).collect()}
    # Where a rule's words are also those of another one, that has the label; it is of the same family.
    family = lambda label: label.split("-")[0]
    assert [(label, text, got[k]) for k, label, text in rows if family(label) not in map(family, got[k])] == []


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_base_columns_match_brute_force(spark):
    r = random.Random(3)
    pool = ["cc", "by", "CC BY", "general", "public", "license", "GNU General Public License", "All rights reserved.", "all", "rights", "é", "İ", "x-y", "\x1c", "_"]
    rows = [(k, r.choice([" ", ", ", "\n"]).join(r.choices(pool, k=r.randrange(30)))) for k in range(200)] + [(None, "cc by"), (900, None), (901, ""), (1, "CC BY CC BY"), (902, "cc by " * 5_000), (902, "cc by " * 5_000)]
    df = spark.createDataFrame([(i, t, "l", 1.0, 2) for i, t in rows], "doc_id long, text string, labels string, score double, n_words int")
    got = sorted(((x.doc_id, x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in license.summary(df).collect()), key=str)
    want = []
    for i, t in rows:
        w = words_of(t)
        places = [(k, label) for phrase, label in license.BASE for p in [phrase.split()] for k in range(len(w)) if w[k : k + len(p)] == p]
        at = [k for k, _ in places]
        want.append((i, len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    assert got == sorted(want, key=str)
