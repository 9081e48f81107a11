"""Boolean trigram queries from regular expressions.

A text can only match a pattern if it satisfies the pattern's query. The query
is a list of clauses, each a set of trigrams that must all occur; one clause
must hold. ``None`` means that the pattern asks for no trigram at all.
"""

from __future__ import annotations

import itertools
import re

from re import _constants as C
from re import _parser as parser

Query = list[frozenset[str]] | None
#: Longest list of alternatives that is followed word by word; beyond it a part of the pattern counts as unknown.
FOLLOWED = 64


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return _least([x | y for x, y in itertools.product(a, b)])


def _least(clauses: list[frozenset[str]]) -> Query:
    """Without clauses that another one implies; unknown as soon as one clause asks for nothing."""
    if any(not c for c in clauses):
        return None
    return [c for i, c in enumerate(clauses) if not any(d < c or d == c and j < i for j, d in enumerate(clauses))]


def _of_words(words: set[str] | None) -> Query:
    if words is None:
        return None
    return _least([frozenset(w[i:i + 3] for i in range(len(w) - 2)) for w in sorted(words)])


def _class(items) -> set[str] | None:
    chars: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            chars.add(chr(value).lower())
        elif op is C.RANGE and value[1] - value[0] < FOLLOWED:
            chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return chars if len(chars) <= 8 else None


def _walk(parsed) -> tuple[set[str] | None, Query]:
    """(all words the part can stand for, if they are few; what it asks for besides)."""
    words: set[str] = {""}
    open_run, query = True, None

    def close():
        nonlocal words, open_run, query
        query, words, open_run = _both(query, _of_words(words)), {""}, False

    for op, value in parsed:
        part, asks = None, None
        if op is C.LITERAL:
            part = {chr(value).lower()}
        elif op is C.IN:
            part = _class(value)
        elif op is C.SUBPATTERN:
            part, asks = _walk(value[3])
        elif op is C.BRANCH:
            each = [_walk(p) for p in value[1]]
            if all(w is not None for w, _ in each):
                part = set().union(*(w for w, _ in each))
            else:
                all_asks = [_both(_of_words(w), q) for w, q in each]
                asks = None if any(q is None for q in all_asks) else _least([c for q in all_asks for c in q])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = value
            inner_words, inner_asks = _walk(inner)
            if inner_words is not None and high <= 3:
                part = {"".join(p) for n in range(low, high + 1) for p in itertools.product(inner_words, repeat=n)}
            elif low:
                asks = _both(_of_words(inner_words), inner_asks)
        elif op is C.AT:
            continue
        if part is not None and len(words) * len(part) <= FOLLOWED:
            words = {a + b for a in words for b in part}
        else:
            close()
            query = _both(query, _both(_of_words(part), asks))
    if open_run:
        return words, None
    close()
    return None, query


def trigram_query(pattern: str) -> Query:
    """The query of a pattern over lower-cased texts."""
    words, query = _walk(parser.parse(pattern, re.UNICODE))
    return _both(_of_words(words), query)
