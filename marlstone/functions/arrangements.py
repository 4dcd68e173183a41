"""Remote type, employment type and seniority from a title and a description.

The three share one reading: text is normalised and cut into tokens; phrases of a vocabulary are found as spans of tokens; spans may be
masked, negated or put aside by their surroundings; what survives must be of one kind.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from .reconcile import CONFLICT, agree, classifier, settle

Span = tuple[int, int, object, bool]  # first token, last token, kind, counts by itself
WINDOW = 3
_SENTENCE = re.compile("[.;:!?]+")
_WORDS = re.compile('[^\\s,()\\[\\]{}"/&\\-–—]+')
_WORDS_AND_MARKS = re.compile('[^\\s,()\\[\\]{}"/&\\-–—]+|[,/&\\-–—]')
_ENCLOSED = re.compile(r"\(([^()\[\]]*)\)|\[([^()\[\]]*)\]")
_BETWEEN = re.compile(r"\s[-–—]\s|[,|:]")
_COMMA = re.compile(r"\s*,\s*")


def normal(text: str, compounds: Iterable[str] = ()) -> str:
    """NFKC, straight apostrophes, case folded; given hyphen compounds (not parts of longer ones) are spaced."""
    text = unicodedata.normalize("NFKC", text).replace("‘", "'").replace("’", "'").casefold()
    for c in compounds:
        text = re.sub(rf"(?<!-)\b{re.escape(c)}\b(?!-)", c.replace("-", " "), text)
    return text


def phrases(texts: list[str], words: re.Pattern = _WORDS, compounds: Iterable[str] = ()) -> list[tuple[str, ...]]:
    """Phrases as tokens."""
    return [tuple(words.findall(normal(t, compounds))) for t in texts]


def spans(tokens: list[str], phrase: tuple[str, ...]) -> list[tuple[int, int]]:
    n = len(phrase)
    return [(i, i + n - 1) for i, t in enumerate(tokens) if t == phrase[0] and tuple(tokens[i : i + n]) == phrase]


def masked(tokens: list[str], excluded: list[tuple[str, ...]]) -> list[bool]:
    """Tokens of excluded phrases, longer phrases first; phrases that overlap an earlier one do not count."""
    out = [False] * len(tokens)
    for p in sorted(excluded, key=len, reverse=True):
        for a, b in spans(tokens, p):
            if not any(out[a : b + 1]):
                out[a : b + 1] = [True] * (b - a + 1)
    return out


def title_segments(text: str) -> list[str]:
    """What stands in parentheses or brackets first, then the rest cut at dashes, commas, bars and colons."""
    inner = [m.group(1) if m.group(1) is not None else m.group(2) for m in _ENCLOSED.finditer(text)]
    return inner + _BETWEEN.split(_ENCLOSED.sub(" ", text))


def distance(at: int, first: int, last: int) -> int:
    return max(first - at, at - last, 0)


def negated(tokens: list[str], found: list[Span], cues: list[int], joined, ahead_first: bool) -> set[int] | None:
    """Numbers of the spans that negations strike: the nearest within the window (all of equal distance), and those joined to a struck one.

    ahead_first: spans after the negation are looked at before those it follows.  None if a negation strikes nothing though there are
    spans: the sentence is then in doubt.
    """
    struck: set[int] = set()
    doubt = False
    for at in cues:
        tiers = [[i for i, s in enumerate(found) if (at < s[0]) == ahead] for ahead in (True, False)] if ahead_first else [range(len(found))]
        near: list[int] = []
        for tier in tiers:
            far = {i: d for i in tier if (d := distance(at, found[i][0], found[i][1])) <= WINDOW}
            near = [i for i in far if far[i] == min(far.values())]
            if near:
                break
        doubt |= not near and bool(found)
        queue = near
        struck.update(near)
        while queue:
            new = [j for i in queue for j in range(len(found)) if j not in struck and joined(tokens, found[i], found[j])]
            queue = list(dict.fromkeys(new))
            struck.update(queue)
    return None if doubt else struck


def _gap(tokens: list[str], a: Span, b: Span) -> list[str] | None:
    if b[0] > a[1]:
        return tokens[a[1] + 1 : b[0]]
    return tokens[b[1] + 1 : a[0]] if a[0] > b[1] else None


def by_or(tokens: list[str], a: Span, b: Span) -> bool:
    gap = _gap(tokens, a, b)
    return gap in (["or"], ["nor"])


def by_or_a(tokens: list[str], a: Span, b: Span) -> bool:
    """Joined by or / nor, with one determiner at most."""
    gap = _gap(tokens, a, b)
    return bool(gap) and gap[0] in ("or", "nor") and (len(gap) == 1 or len(gap) == 2 and gap[1] in ("a", "an", "the"))


# ---- remote type.  Fixed values: phrases of each kind, where they count, and what puts them aside.
REMOTE_BARE = {"remote": phrases(["remote", "remotely", "work from home", "work from anywhere", "wfh"]), "hybrid": phrases(["hybrid"]), "onsite": phrases(["onsite", "on site", "in office", "in person"])}
REMOTE_TITLE = {"remote": phrases(["fully remote", "100% remote", "work remotely", "work from home", "work from anywhere", "wfh"]), "onsite": phrases(["work in the office"])}
REMOTE_PREFIXES = {"remote": ["remote"], "hybrid": ["hybrid"], "onsite": ["onsite", "on site"]}
REMOTE_NOUNS = ["role", "position", "job", "work arrangement", "schedule", "attendance", "attendance requirement"]
REMOTE_SUFFICIENT = {"remote": phrases(["work remotely", "work from home", "work from anywhere", "wfh"]), "onsite": phrases(["work in the office"])}
REMOTE_BLOCKER = phrases(["required to be in the office"])
REMOTE_EXCLUDED = phrases(["remote sensing", "remote desktop", "remote location", "hybrid cloud", "remote systems", "remote team"])
REMOTE_CONTEXT = frozenset(["stipend", "collaboration", "vpn", "protocol", "allowance", "team", "teams", "system", "systems", "device", "devices", "interview", "meeting", "meetings"])
REMOTE_NEGATIONS = frozenset(["not", "no", "isn't", "aren't", "without", "unavailable"])
_REMOTE_SAID = {k: phrases([f"{x} {n}" for x in v for n in REMOTE_NOUNS]) + REMOTE_SUFFICIENT.get(k, []) for k, v in REMOTE_PREFIXES.items()}


def _open_spans(tokens: list[str], mask: list[bool], phrase: tuple[str, ...]) -> list[tuple[int, int]]:
    return [(a, b) for a, b in spans(tokens, phrase) if not any(mask[a : b + 1])]


def remote_title(text: str | None):
    if not (text or "").strip():
        return None
    text = normal(text)
    tokens = _WORDS.findall(text)
    mask = masked(tokens, REMOTE_EXCLUDED)
    kinds = {k for k, ps in REMOTE_TITLE.items() for p in ps if _open_spans(tokens, mask, p)}
    for segment in title_segments(text):
        own = _WORDS.findall(segment)
        left = tuple(t for t, m in zip(own, masked(own, REMOTE_EXCLUDED), strict=True) if not m)
        kinds |= {k for k, ps in REMOTE_BARE.items() if left in ps}
    return settle(kinds)


def remote_description(text: str | None) -> tuple:
    """(reading, whether attendance is required)."""
    kinds, blocked = set(), False
    for sentence in _SENTENCE.split(normal(text)) if (text or "").strip() else ():
        places = [(m.group(), m.start(), m.end()) for m in _WORDS.finditer(sentence)]
        tokens = [t for t, _, _ in places]
        mask = masked(tokens, REMOTE_EXCLUDED)
        found: list[Span] = [(a, b, k, True) for k, ps in [*_REMOTE_SAID.items(), ("attendance", REMOTE_BLOCKER)] for p in ps for a, b in _open_spans(tokens, mask, p)]
        found += [(a, b, k, False) for k, ps in REMOTE_BARE.items() for p in ps for a, b in _open_spans(tokens, mask, p)]
        where = lambda cues: [i for i, t in enumerate(tokens) if t in cues and not mask[i]]  # noqa: E731,B023
        struck = negated(tokens, found, where(REMOTE_NEGATIONS), by_or, False)
        if struck is None:
            continue
        aside = struck | {i for i, s in enumerate(found) for c in where(REMOTE_CONTEXT) if distance(c, s[0], s[1]) <= WINDOW}

        def contrasts(s: Span) -> bool:
            """Parted from a negated span by a comma alone."""
            for o in (found[i] for i in struck):  # noqa: B023
                a, b = (s, o) if o[0] > s[1] else (o, s)
                if b[0] > a[1] and _COMMA.fullmatch(sentence[places[a[1]][2] : places[b[0]][1]]):  # noqa: B023
                    return True
            return False

        for i, s in enumerate(found):
            if i not in aside and (s[3] or contrasts(s)):
                if s[2] == "attendance":
                    blocked = True
                else:
                    kinds.add(s[2])
    return settle(kinds), blocked


def remote_type_of(title: str | None, description: str | None) -> tuple:
    reading, blocked = remote_description(description)
    value, provenance = agree(remote_title(title), reading)
    return (None, "unavailable") if blocked and value == "remote" else (value, provenance)


# ---- employment type.
EMPLOYMENT_COMPOUNDS = ("full-time", "part-time", "contract-to-hire", "temp-to-perm")


def _work(texts: list[str]) -> list[tuple[str, ...]]:
    return phrases(texts, _WORDS_AND_MARKS, EMPLOYMENT_COMPOUNDS)


EMPLOYMENT_BARE = {"full_time": _work(["full-time", "full time"]), "part_time": _work(["part-time", "part time"]), "seasonal": _work(["seasonal"]), "internship": _work(["internship", "intern"])}
EMPLOYMENT_NOUNS = {"full_time": ["position", "role", "job", "basis", "employment"], "part_time": ["position", "role", "job", "basis", "employment"], "seasonal": ["position", "role", "job", "basis", "employment", "work"], "internship": ["position", "role", "program", "opportunity"]}
EMPLOYMENT_OTHER = _work(["contract", "temporary", "temp", "contract to hire", "temp to perm", "1099", "w2", "w 2", "per diem"])
EMPLOYMENT_NEGATIONS = frozenset(["not", "no", "neither", "isn't", "aren't", "without", "unavailable"])
_EMPLOYMENT_SAID = {k: [EMPLOYMENT_BARE[k][0] + (n,) for n in nouns] for k, nouns in EMPLOYMENT_NOUNS.items()}


def _without(tokens: list[str], excluded: list[tuple[str, ...]]) -> list[str]:
    return [t for t, m in zip(tokens, masked(tokens, excluded), strict=True) if not m]


def employment_title(text: str | None):
    if not (text or "").strip():
        return None
    segments = [tuple(_without(_WORDS_AND_MARKS.findall(s), EMPLOYMENT_OTHER)) for s in title_segments(normal(text, EMPLOYMENT_COMPOUNDS))]
    return settle(k for k, ps in EMPLOYMENT_BARE.items() for s in segments if s in ps)


def employment_description(text: str | None):
    kinds = set()
    for sentence in _SENTENCE.split(normal(text, EMPLOYMENT_COMPOUNDS)) if (text or "").strip() else ():
        tokens = _without(_WORDS_AND_MARKS.findall(sentence), EMPLOYMENT_OTHER)
        found: list[Span] = [(a, b, k, said) for table, said in ((_EMPLOYMENT_SAID, True), (EMPLOYMENT_BARE, False)) for k, ps in table.items() for p in dict.fromkeys(ps) for a, b in spans(tokens, p)]
        struck = negated(tokens, found, [i for i, t in enumerate(tokens) if t in EMPLOYMENT_NEGATIONS], by_or_a, True)
        if struck is not None:
            kinds |= {s[2] for i, s in enumerate(found) if s[3] and i not in struck}
    return settle(kinds)


def employment_type_of(title: str | None, description: str | None) -> tuple:
    return agree(employment_title(title), employment_description(description))


# ---- seniority.
SENIORITY_COMPOUNDS = ("entry-level", "mid-level")


def _rank(texts: list[str]) -> list[tuple[str, ...]]:
    return phrases(texts, _WORDS_AND_MARKS, SENIORITY_COMPOUNDS)


SENIORITY_TITLE = {"entry_level": _rank(["entry level", "junior", "jr", "jr."]), "mid_level": _rank(["mid level"]), "senior": _rank(["senior", "sr", "sr."]), "staff": _rank(["staff"])}
SENIORITY_DESCRIPTION = {"entry_level": _rank(["entry level", "junior", "jr"]), "mid_level": _rank(["mid level"]), "senior": _rank(["senior"]), "staff": _rank(["staff"])}
SENIORITY_EXPLICIT = {
    "principal": _rank(["principal engineer", "principal architect", "principal consultant", "principal scientist", "principal analyst", "principal software engineer", "principal data scientist", "principal product manager"]),
    "director": _rank(["director of engineering", "engineering director", "director of product", "product director", "director of operations", "director of technology", "technology director", "director of software engineering"]),
}
SENIORITY_ROOTS = SENIORITY_TITLE | {"principal": _rank(["principal"]), "director": _rank(["director"])}
SENIORITY_EXCLUDED = _rank(["senior living", "senior center", "senior citizen", "senior year", "senior thesis", "senior executive assistant", "senior vice president", "senior vp"])
SENIORITY_ANCHORS = _rank(["this is", "it is", "the position is", "this position is", "the role is", "this role is", "we are hiring", "seeking"])
SENIORITY_NEGATORS = (("not", "either"), ("neither",), ("not",), ("no",))
_ARTICLES, _MARKS = ("a", "an", "the"), frozenset([",", "/", "&", "-", "–", "—"])


def _starts(tokens: list[str], options: Iterable[tuple[str, ...]]) -> int:
    """Length of the longest option that the tokens start with, 0 for none."""
    return max((len(p) for p in options if tuple(tokens[: len(p)]) == p), default=0)


def _leading(tokens: list[str], bare: dict) -> tuple[str, int] | None:
    """(rank, tokens used) of the qualifier at the start; senior staff and senior principal count as the second word."""
    for p in bare["senior"]:
        rest = tokens[len(p) :]
        if tuple(tokens[: len(p)]) == p and rest[:1] in (["staff"], ["principal"]):
            return rest[0], len(p) + 1
    best = max(((_starts(tokens, ps), k) for k, ps in [*bare.items(), *SENIORITY_EXPLICIT.items()]), key=lambda x: x[0])
    return (best[1], best[0]) if best[0] else None


def seniority_title(text: str | None):
    kinds = set()
    for segment in title_segments(normal(text, SENIORITY_COMPOUNDS)) if (text or "").strip() else ():
        tokens = _without(_WORDS_AND_MARKS.findall(segment), SENIORITY_EXCLUDED)
        if got := _leading(tokens, SENIORITY_TITLE):
            kinds |= {got[0]} | {k for k, ps in SENIORITY_ROOTS.items() if k != got[0] and any(spans(tokens[got[1] :], p) for p in ps)}
    return settle(kinds)


def seniority_description(text: str | None):
    kinds = set()
    for sentence in _SENTENCE.split(normal(text, SENIORITY_COMPOUNDS)) if (text or "").strip() else ():
        tokens = _without(_WORDS_AND_MARKS.findall(sentence), SENIORITY_EXCLUDED)
        anchor = _starts(tokens, SENIORITY_ANCHORS)
        if not anchor:
            continue
        tokens = tokens[anchor:]
        no = _starts(tokens, SENIORITY_NEGATORS)
        tokens = tokens[no:]
        if tokens[:1] and tokens[0] in _ARTICLES:
            tokens = tokens[1:]
        got = _leading(tokens, SENIORITY_DESCRIPTION)
        if not got:
            continue
        tokens = tokens[got[1] :]
        if not no:
            kinds.add(got[0])
            near = list(tokens)
            while near and near[0] in _MARKS:
                near.pop(0)
            other = [k for k, ps in SENIORITY_ROOTS.items() if k != got[0] and _starts(near, ps)]
            if other:
                kinds.add(other[0])
                continue
        if tokens[:1] and tokens[0] in ("or", "nor"):
            second = _leading(tokens[2 if tokens[1:2] and tokens[1] in _ARTICLES else 1 :], SENIORITY_DESCRIPTION)
            if second and not no:
                kinds.add(second[0])
    return settle(kinds)


def seniority_of(title: str | None, description: str | None) -> tuple:
    return agree(seniority_title(title), seniority_description(description))


_ANSWER = "value string, provenance string"
classify_remote_type = classifier(remote_type_of, _ANSWER)
classify_employment_type = classifier(employment_type_of, _ANSWER)
classify_seniority = classifier(seniority_of, _ANSWER)
__all__ = ["CONFLICT", "classify_employment_type", "classify_remote_type", "classify_seniority"]
