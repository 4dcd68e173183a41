"""Skills named in a title and a description, by a taxonomy."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import taxonomy
from .primitives import COVERED, lookup_key_of

# Keys that are also common words, what makes them sure, labels that open a list, and cues around "go".
AMBIGUOUS = frozenset({"go", "node"})
BESIDE_ROLE = frozenset({"c", "r", "go"})
ROLE_NOUNS = frozenset({"developer", "engineer", "programmer"})
LABELS = ("tech stack", "technologies", "languages", "skills")
CUES = ("production-quality coding", "coding ability", "production experience", "hands-on experience", "professional experience", "proficient in", "proficiency in", "fluent in", "fluency in")

_CUT = re.compile(r"[,;|:/]")
_TOKEN = re.compile(r'[^\s()\[\]{}"&]+')
_STOPS = re.compile(r"[.!?]+")
_LABEL = re.compile(rf"(?:{'|'.join(x.replace(' ', '[\t\n\r ]+') for x in LABELS)})[\t\n\r ]*:[\t\n\r ]*")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_CUES = [c.split() for c in CUES]


def _bare(token: str) -> str:
    """Without one final mark; two or more are kept."""
    return token[:-1] if token[-1:] in tuple(".!?") and token[-2:-1] not in tuple(".!?") else token


class Reader:
    def __init__(self, entries=None):
        self.index = taxonomy.index(taxonomy.SKILLS if entries is None else entries)

    def segments(self, text: str) -> list[list[tuple[str, int]]]:
        """(lookup key, place) of the tokens of each segment."""
        out, at = [], 0
        for end, after in [(m.start(), m.end()) for m in _CUT.finditer(text)] + [(len(text), len(text))]:
            out.append([(lookup_key_of(_bare(m.group())), m.start()) for m in _TOKEN.finditer(text, at, end)])
            at = after
        return out

    def sure(self, key: str) -> bool:
        return key in self.index and len(key) > 1 and key not in AMBIGUOUS

    def doubtful(self, key: str) -> bool:
        return key in self.index and not self.sure(key)

    def title(self, text: str | None) -> set[str]:
        found = set()
        for segment in self.segments(text) if (text or "").strip() else ():
            keys = [k for k, _ in segment]
            for i, key in enumerate(keys):
                by_role = key in BESIDE_ROLE and keys[i + 1 : i + 2] and keys[i + 1] in ROLE_NOUNS
                if self.sure(key) or self.doubtful(key) and (len(keys) == 1 or by_role):
                    found.add(key)
        return found

    def description(self, text: str | None) -> set[str]:
        if not (text or "").strip():
            return set()
        segments = self.segments(text)
        found = {k for s in segments for k, _ in s if self.sure(k)}
        for region in self.regions(text):
            found |= {s[0][0] for s in self.segments(region) if len(s) == 1 and self.doubtful(s[0][0])}
        return found | self.go(text, segments)

    def regions(self, text: str) -> list[str]:
        """What follows a label that opens the text, a line or a sentence, up to the next end of a sentence."""
        stops = [m.end() for m in _STOPS.finditer(text)]
        opens = set()
        for end in stops:
            after = end
            while after < len(text) and text[after] in COVERED:
                after += 1
            if after > end:
                opens.add(after)
        closes = [e for e in stops if e == len(text) or text[e].isspace() or unicodedata.category(text[e]) == "Cf"]
        out, low = [], text.translate(_LOWER)
        for label in LABELS:  # labels may overlap each other, not themselves
            for m in re.finditer(rf"{label.replace(' ', '[\t\n\r ]+')}[\t\n\r ]*:[\t\n\r ]*", low):
                start, end = m.span()
                odd_space = text[end : end + 1].isspace() and text[end] not in COVERED
                if (start == 0 or text[start - 1] == "\n" or start in opens) and not odd_space:
                    close = next((m2.end() for m2 in _STOPS.finditer(text, end) if m2.end() in closes), len(text))
                    out.append(text[end:close])
        return out

    def go(self, text: str, segments: list[list[tuple[str, int]]]) -> set[str]:
        """"go" alone between other skills of its sentence, where the sentence speaks of coding."""
        ends = [m.end() for m in re.finditer(r"\n|[.!?]+", text)]
        sentence = lambda place: bisect_right(ends, place)
        for i, own in enumerate(segments):
            if [k for k, _ in own] != ["go"] or "go" not in self.index:
                continue
            number = sentence(own[0][1])
            beside = [s[-1] for s in segments[max(0, i - 1) : i] if s] + [s[0] for s in segments[i + 1 : i + 2] if s]
            if any(self.sure(k) and sentence(p) == number for k, p in beside):
                a, b = ([0] + ends)[number], (ends + [len(text)])[number]
                words = [w[:-1] if w.endswith(":") else w for w in (_bare(t) for t in _TOKEN.findall(text[a:b].translate(_LOWER)))]
                if any(words[j : j + len(c)] == c for c in _CUES for j in range(len(words))):
                    return {"go"}
        return set()

    def skills(self, title: str | None, description: str | None) -> list[tuple[str, str, str]]:
        """(canonical id, display name, provenance), in order of id."""
        said = {self.index[k] for k in self.description(description)}
        named = {self.index[k] for k in self.title(title)}
        return sorted((c, d, "parsed_description" if (c, d) in said else "inferred") for c, d in said | named)


def classify_skills(title: Column, description: Column, entries=None) -> Column:
    """array of struct(canonical_id, display_name, provenance)."""

    @F.pandas_udf("array<struct<canonical_id:string,display_name:string,provenance:string>>")
    def run(t: pd.Series, d: pd.Series) -> pd.Series:
        reader, seen, out = Reader(entries), {}, []
        for pair in zip(t.where(t.notna(), None), d.where(d.notna(), None), strict=True):
            if pair not in seen:
                seen[pair] = [{"canonical_id": c, "display_name": n, "provenance": p} for c, n, p in reader.skills(*pair)]
            out.append(seen[pair])
        return pd.Series(out)

    return run(title, description)
