"""Column helpers for keyword tables and falsy values."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def low(c: str | Column) -> Column:
    return F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def has(text: Column, *keywords: str) -> Column:
    """Whether any keyword is contained."""
    out = F.lit(False)
    for k in keywords:
        out = out | text.contains(k)
    return out


def first_key(text: Column, table: dict[str, object], default: object) -> Column:
    """The value of the first key that the text contains."""
    out = None
    for key, value in table.items():
        test = text.contains(key)
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out.otherwise(F.lit(default))


def first_class(text: Column, table: dict[str, list[str]], default: str | None = None) -> Column:
    """The first class of which the text contains a keyword."""
    out = None
    for key, keywords in table.items():
        test = has(text, *keywords)
        out = F.when(test, F.lit(key)) if out is None else out.when(test, F.lit(key))
    return out.otherwise(F.lit(default))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cores(keywords: list[str]) -> tuple[list[str], list[int]]:
    """Words that several keywords contain, those of most keywords first, and of each keyword the place of such a word (-1: none)."""
    found, of = [], [-1] * len(keywords)
    words = dict.fromkeys(w for k in keywords for w in k.split() if len(w) > 2)
    while True:
        left = {w: [n for n, k in enumerate(keywords) if of[n] < 0 and w in k] for w in words}
        best = max(left, key=lambda w: len(left[w]), default=None)
        if best is None or len(left[best]) < 2:
            return found, of
        for n in left[best]:
            of[n] = len(found)
        found.append(best)


def hits(text: Column, keywords: list[str]) -> Column:
    """The keywords that the text contains, in their order. Where several share a word that the text doesn't contain, none of them is looked for."""
    shared, of = cores(keywords)
    if not shared:
        return let(text, lambda t: F.filter(F.array(*map(F.lit, keywords)), lambda k: t.contains(k)))
    table = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in zip(keywords, of, strict=True)))
    tested = lambda t, there: F.transform(F.filter(table, lambda x: ((x["n"] < 0) | F.get(there, x["n"])) & t.contains(x["k"])), lambda x: x["k"])
    return let(text, lambda t: let(F.transform(F.array(*map(F.lit, shared)), lambda w: t.contains(w)), lambda there: tested(t, there)))


def lookup(key: Column, table: dict[str, float], default: float) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def listed(*pairs: tuple[Column, str | Column]) -> Column:
    """The texts whose conditions hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in pairs)))


def truthy(c: str) -> Column:
    """Null for zero, as a number that counts as missing when zero."""
    return F.nullif(F.col(c), F.lit(0))


def class_words(text: Column, *tables: dict[str, list[str]]) -> Column:
    """For each class of all tables (in order) how many words its keywords that the text contains have (array<int>); a keyword counts once, and in every class that lists it. One pass over the text for all keywords, whatever their number: an automaton that a worker builds once."""
    classes = [ks for table in tables for ks in table.values()]
    held: list = []

    def automaton():
        if not held:
            import ahocorasick

            out = ahocorasick.Automaton()
            for keyword in dict.fromkeys(k for ks in classes for k in ks):
                out.add_word(keyword, (keyword, len(keyword.split()), [n for n, ks in enumerate(classes) if keyword in ks]))
            out.make_automaton()
            held.append(out)
        return held[0]

    @F.pandas_udf("array<int>")
    def counted(texts: pd.Series) -> pd.Series:
        find, out = automaton().iter, []
        for t in texts:
            words, seen = [0] * len(classes), set()
            for _, (keyword, n, of) in find(t or ""):
                if keyword not in seen:
                    seen.add(keyword)
                    for c in of:
                        words[c] += n
            out.append(words)
        return pd.Series(out)

    return counted(text)
