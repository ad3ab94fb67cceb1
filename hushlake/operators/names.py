"""Person names without a model: titles, a name list of the caller, sign-offs, and the same name elsewhere."""

from __future__ import annotations

from dataclasses import dataclass, field

import regex

from hushlake.functions.normalize import View, strip_marks

#: Words that are no person, titles, sign-offs, words that speak for a name.
BLOCKED = frozenset(x.lower() for x in ("Amelia", "Factorial", "Leon", "Captain", "Full", "Stack", "Developer", "Director", "Crew", "Planning", "Bonjour", "Cordialement"))
TITLES = ("M.", "Mme", "Mlle", "Dr", "Pr", "Me", "Capitaine", "Commandant", "Lieutenant", "Colonel", "Général", "Mr", "Mr.", "Mrs", "Mrs.", "Ms", "Ms.", "Miss", "Dr.", "Prof", "Prof.", "Captain", "Cpt", "Lt")
SIGN_OFF = regex.compile(r"(?im)(?:best\s+regards|regards|brgds|brds|cordialement|cdlt|bien\s+[àa]\s+vous|sincerely|cheers|merci|thanks)[,.]?\s*\n?\s*([A-Z\p{Lu}][\p{L}'-]+)")
CONTEXT = (
    "passenger", "passager", "passagère", "name", "nom", "pilot", "pilote", "captain", "capitaine", "commandant", "crew", "équipage", "equipage", "copilot", "copilote", "member", "membre",
    "contact", "person", "personne", "client", "patient", "employee", "employé", "employée", "salarié", "user", "utilisateur", "utilisatrice", "author", "auteur",
)
_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_WORD = regex.compile(r"\S+")


@dataclass(frozen=True)
class NameLists:
    """First and last names, lower case; the caller's own data."""

    first: frozenset[str] = field(default=frozenset())
    last: frozenset[str] = field(default=frozenset())


_TITLE_CASE, _CAPITALS = regex.compile(r"\p{Lu}(?:\p{Ll}|[-']\p{Lu})*"), regex.compile(r"(?:[-']*\p{Lu}){2,}[-']*")


def name_like(word: str) -> bool:
    """Title case, a capital after each hyphen or apostrophe and none of them last; or two capitals or more and nothing else. One ASCII letter is no name."""
    return len(word.encode()) >= 2 and bool(_TITLE_CASE.fullmatch(word) or _CAPITALS.fullmatch(word))


def extend(text: str, start: int, end: int, crew: frozenset[str], most: int = 2) -> int:
    """End of a name with up to ``most`` name-like words that follow on its line."""
    for _ in range(most):
        m = regex.compile(r"[^\S\n]+(\S+)").match(text, end)
        if not m:
            break
        word = m[1].rstrip(_PUNCT)
        if not name_like(word) or word.lower() in BLOCKED or word in crew:
            break
        end = m.start(1) + len(word)
        if len(word) < len(m[1]):
            break
    return end


def sign_offs(text: str) -> list[tuple[int, int]]:
    return [m.span(1) for m in SIGN_OFF.finditer(text) if len(m[1].encode()) >= 2 and name_like(m[1]) and m[1].lower() not in BLOCKED]


def consistent(text: str, people: list[str]) -> list[tuple[int, int]]:
    """Other places of the parts of full names, accents or not."""
    parts = set()
    for p in people:
        words = p.split()
        parts |= {w for i, w in enumerate(words) if len(words) > 1 and len(w.encode()) >= (2 if i == 0 else 3)}
    found, plain = [], None
    for part in sorted(parts):
        found += [m.span() for m in regex.finditer(rf"\b{regex.escape(part)}\b", text)]
        if (bare := strip_marks(part)) != part:
            plain = plain or View(text).stripped()
            found += [plain.source(*m.span()) for m in regex.finditer(rf"\b{regex.escape(bare)}\b", plain.text)]
    return found


def heuristic(text: str, names: NameLists, crew: frozenset[str] = frozenset()) -> list[tuple[int, int, float]]:
    """Names after a title, then names that begin with a known first name; (start, end, score)."""
    raw = text.encode()

    def near(a: int, b: int) -> float:
        s, e = len(text[:a].encode()), len(text[:b].encode())
        window = raw[max(0, s - 80) : e + 80].decode("utf-8", "ignore").lower()
        return 0.15 if any(k in window for k in CONTEXT) else 0.0

    found = []
    for m in regex.finditer(r"(?<!\w)(?:" + "|".join(sorted(map(regex.escape, TITLES), key=len, reverse=True)) + r")[^\S\n]+(?=\p{Lu})", text):
        end = extend(text, m.end(), m.end() - 1, crew, 3)
        if end > m.end():
            found.append((m.end(), end, (0.75 if " " in text[m.end() : end] else 0.65) + near(m.end(), end)))
    words = list(_WORD.finditer(text))
    for m in words:
        word = m[0].strip(_PUNCT)
        a = m.start() + m[0].index(word) if word else m.start()
        if not word or not name_like(word) or word.lower() not in names.first or word.lower() in BLOCKED:
            continue
        b = a + len(word)
        end = extend(text, a, b, crew) if m.end() == b else b
        known = any(w.lower() in names.last for w in text[b:end].split())
        boost = near(a, end)
        if end > b:
            score = (0.70 if known else 0.55) + boost
        elif boost:
            score = 0.50
        else:
            continue
        if not any(s < end and a < e for s, e, _ in found):
            found.append((a, end, score))
    return sorted((s, e, min(1.0, x)) for s, e, x in found)
