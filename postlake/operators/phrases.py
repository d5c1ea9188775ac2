"""Which lists of postings answer a phrase.

The index keeps postings of pairs of adjacent words where either is common, so the list of a common word is never read
for a phrase: each of its places is covered by a pair, and other words by their own lists. What is common is settled when
a batch is written and noted beside it, so batches may differ; a document is in one batch, so each set of batches that
agree on the words of a phrase is covered by itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .search import Term

#: A word is common if it is in this share of a batch's documents, and in LEAST of them; of more words than COMMON those
#: of most documents are, and the lists of the rest are read as of any word.
SHARE, LEAST, COMMON = 1 / 8, 32, 256


@dataclass(frozen=True)
class Part:
    """One list: a token of the postings, or of the pairs; last: which word of the phrase it ends with."""

    token: str
    last: int
    paired: bool = False
    #: Of a prefix: all tokens that begin so.
    begun: bool = False


def cover(term: Term, common: set[str] | frozenset[str] = frozenset()) -> list[Part]:
    """Lists that together have every word of the phrase."""
    words, end = term.words, len(term.words) - 1

    def paired(i: int) -> bool:
        # What a prefix may go on to isn't known to be common, so its pairs are all there only after a common word.
        return 0 <= i < end and (words[i] in common or (words[i + 1] in common and not (term.prefix and i + 1 == end)))

    def pair(i: int) -> Part:
        return Part(f"{words[i]} {words[i + 1]}", i + 1, True, term.prefix and i + 1 == end)

    parts, i = [], 0
    while i <= end:
        if paired(i):
            parts.append(pair(i))
            i += 2
        else:
            parts.append(pair(i - 1) if paired(i - 1) else Part(words[i], i, begun=term.prefix and i == end))
            i += 1
    return parts


@dataclass
class Pairs:
    """The postings of pairs, and the words of a query that are common in each batch."""

    rows: DataFrame | None = None
    common: dict[int, set[str]] = field(default_factory=dict)
    #: Documents of the query's words, where known: lists are joined from the rarest on.
    df: dict[str, int] = field(default_factory=dict)

    def covers(self, term: Term) -> list[tuple[list[int] | None, list[Part]]]:
        """(batches, lists) by which the phrase is found; None: all batches."""
        agree: dict[frozenset[str], list[int]] = {}
        for batch, words in self.common.items():
            agree.setdefault(frozenset(words & set(term.words)), []).append(batch)
        if len(agree) < 2:
            return [(None, self._rarest_first(cover(term, next(iter(agree), frozenset()))))]
        return [(sorted(batches), self._rarest_first(cover(term, words))) for words, batches in agree.items()]

    def _rarest_first(self, parts: list[Part]) -> list[Part]:
        # A pair is in no more documents than its rarer word.
        return sorted(parts, key=lambda p: min(self.df.get(w, 0) for w in p.token.split(" ")) if not p.begun else max(self.df.values(), default=0))
