"""The same keyword tables as SQL text, for oracles."""

from __future__ import annotations


def q(v: object) -> str:
    return "NULL" if v is None else f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else repr(v)


def has(text: str, *keywords: str) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(k)})" for k in keywords) + ")"


def first_key(text: str, table: dict, default: object) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, {q(k)}) THEN {q(v)}" for k, v in table.items()) + f" ELSE {q(default)} END"


def first_class(text: str, table: dict, default: object = None) -> str:
    return "CASE " + " ".join(f"WHEN {has(text, *ks)} THEN {q(k)}" for k, ks in table.items()) + f" ELSE {q(default)} END"


def hits(text: str, keywords: list[str]) -> str:
    return f"list_filter([{', '.join(map(q, keywords))}], lambda k: contains({text}, k))"


def lookup(key: str, table: dict, default: object) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE {q(default)} END"


def listed(*pairs: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in pairs) + "], lambda x: x IS NOT NULL)"


def low(c: str) -> str:
    return f"lower(coalesce({c}, ''))"
