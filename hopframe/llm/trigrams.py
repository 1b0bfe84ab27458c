"""Boolean trigram queries from regular expressions, and a trigram index of a block of texts.

The index holds postings only for trigrams that some query names; letters are folded to
lower case in both, so a query is a necessary condition whatever the case rules are.
"""

from __future__ import annotations

from itertools import product
from re import _constants as C
from re import _parser as sre

import numpy as np

#: exact strings kept while walking a pattern; beyond it they are turned into a query
MOST_STRINGS = 64
TRUE = ("and", ())


def _grams(s: str) -> tuple:
    raw = s.encode()
    return ("and", tuple(sorted({raw[i : i + 3] for i in range(len(raw) - 2)})))


def _both(a, b):
    return b if a == TRUE else a if b == TRUE else ("and", (a, b))


def _either(parts):
    parts = list(dict.fromkeys(parts))
    return TRUE if TRUE in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _from_strings(strings: set[str]):
    return TRUE if min(map(len, strings)) < 3 else _either([_grams(s) for s in sorted(strings)])


def _class_members(items) -> set[str] | None:
    found: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            found.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < 8:
            found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def _walk(nodes) -> tuple[set[str] | None, tuple]:
    """(all strings it can match, or None; a query that every match satisfies)."""
    now: set[str] = {""}
    query, exact = TRUE, True

    def flush():
        nonlocal now, query, exact
        query, now, exact = _both(query, _from_strings(now)), {""}, False

    def extend(strings: set[str]):
        nonlocal now
        if len(now) * len(strings) > MOST_STRINGS:
            flush()
        now = {a + b for a, b in product(now, strings)}

    for op, arg in nodes:
        if op is C.LITERAL:
            extend({chr(arg).lower()})
        elif op is C.IN and (members := _class_members(arg)):
            extend(members)
        elif op is C.SUBPATTERN:
            strings, inner = _walk(arg[3])
            if strings is None:
                flush()
                query = _both(query, inner)
            else:
                extend(strings)
        elif op is C.BRANCH:
            ways = [_walk(way) for way in arg[1]]
            if all(s is not None for s, _ in ways) and len(every := set().union(*(s for s, _ in ways))) <= MOST_STRINGS:
                extend(every)
            else:
                flush()
                query = _both(query, _either([_from_strings(s) if s is not None else q for s, q in ways]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, inner = arg
            strings, inner_query = _walk(inner)
            if strings is not None and most == 1:
                extend(strings | {""} if least == 0 else strings)
            else:
                if strings is not None and least and len(strings) ** min(least, 3) <= MOST_STRINGS:
                    for _ in range(min(least, 3)):
                        extend(strings)
                elif least:
                    flush()
                    query = _both(query, inner_query if strings is None else _from_strings(strings))
                flush()
        elif op not in (C.AT, C.ASSERT, C.ASSERT_NOT):
            flush()
    if exact:
        return now, _from_strings(now)
    return None, _both(query, _from_strings(now))


def trigram_query(pattern: str):
    """The Boolean query of a pattern, TRUE if it has no mandatory trigram."""
    strings, query = _walk(sre.parse(pattern))
    return _from_strings(strings) if strings is not None else query


def named(query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set().union(*(named(q) for q in query[1])) if query[1] else set()


def code(gram: bytes) -> int:
    return gram[0] << 16 | gram[1] << 8 | gram[2]


def postings(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> dict[int, np.ndarray]:
    """Texts of each wanted trigram (a table over all codes says which are) in folded bytes."""
    if len(data) < 3:
        return {}
    codes = data[:-2].astype(np.uint32) << 16
    codes |= data[1:-1].astype(np.uint32) << 8
    codes |= data[2:]
    at = np.flatnonzero(wanted[codes])
    doc = np.searchsorted(offsets, at, "right") - 1
    pairs = np.unique(codes[at].astype(np.int64) << 32 | doc)
    grams = pairs >> 32
    cuts = np.flatnonzero(np.diff(grams)) + 1
    return {int(g): p & 0xFFFFFFFF for g, p in zip(grams[np.concatenate([[0], cuts])], np.split(pairs, cuts))} if len(pairs) else {}


_NONE = np.zeros(0, np.int64)


def answer(query, index: dict[int, np.ndarray], n: int) -> np.ndarray:
    """Texts that satisfy a query, by intersecting and joining postings."""
    if isinstance(query, bytes):
        return index.get(code(query), _NONE)
    if query == TRUE:
        return np.arange(n)
    parts = [answer(q, index, n) for q in query[1]]
    found = parts[0]
    for p in parts[1:]:
        found = np.intersect1d(found, p, assume_unique=True) if query[0] == "and" else np.union1d(found, p)
    return found
