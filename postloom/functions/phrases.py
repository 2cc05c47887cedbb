"""One-pass recognition of a fixed phrase list in a text."""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions.text import bind, sql_literal, literal_map, literal_strings


class PhraseScanner:
    """Finds every phrase of a list on word boundaries with a single regex scan.

    At each boundary the pattern looks ahead for the longest phrase that starts
    there. A shorter phrase starting at the same place must be a prefix of it, so
    the prefixes to add are known beforehand. No phrase here can overlap itself, so
    the number of starts equals the number of non-overlapping matches.
    """

    def __init__(self, phrases: Sequence[str], letters: str = "a-z0-9"):
        self.phrases = list(phrases)
        inner = re.compile(f"[{letters}]")
        by_first: dict[str, list[str]] = {}
        for p in sorted(self.phrases, key=len, reverse=True):
            by_first.setdefault(p[0], []).append(p[1:])
        groups = "|".join(
            re.escape(first) + "(?:" + "|".join(re.escape(rest) for rest in rests) + ")"
            for first, rests in sorted(by_first.items())
        )
        self.pattern = f"(?<![{letters}])(?=((?:{groups})(?![{letters}])))"
        self.also = {
            p: [q for q in self.phrases if q != p and p.startswith(q) and not inner.match(p[len(q)])]
            for p in self.phrases
        }

    def hits(self, c: Column) -> Column:
        """Array of matched phrases, one element per occurrence."""
        found = F.regexp_extract_all(c, F.lit(self.pattern), 1)
        nested = {p: qs for p, qs in self.also.items() if qs}
        if not nested:
            return found
        return bind(found, lambda hs: F.concat(hs, F.flatten(F.transform(hs, lambda h: self._prefixes(h, nested)))))

    @staticmethod
    def _prefixes(hit: Column, nested: dict[str, list[str]]) -> Column:
        cases = " ".join(f"{sql_literal(p)}, array({', '.join(map(sql_literal, qs))})," for p, qs in nested.items())
        return F.coalesce(F.element_at(F.expr(f"map({cases[:-1]})"), hit), literal_strings([]))


def lookup(term: Column, table: dict[str, object]) -> Column:
    """Value of ``term`` in a small literal table, null when absent."""
    return F.element_at(literal_map(table), term)
