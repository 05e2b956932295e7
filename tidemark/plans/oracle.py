"""SQL that the queries are held against, from named common table expressions."""

from __future__ import annotations

import re

from tidemark.sources.adapters import VIEWS

#: Beyond the adapters: steps that several oracles share.
STEPS: dict[str, str] = {}


def _known() -> dict[str, str]:
    return {n: re.sub(r"\{(\w+)\}", r"\1", s) for n, s in VIEWS.items()} | STEPS


def oracle(select: str) -> str:
    """The SELECT with the expressions that it needs, in the order in which they need each other."""
    known, order = _known(), []

    def need(sql: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b\w+\b", sql)):
            if name in known and name not in order and f"{name}." not in order:
                order.append(f"{name}.")
                need(known[name])
                order.remove(f"{name}.")
                order.append(name)

    need(select)
    if select.startswith("WITH RECURSIVE "):  # its own expressions come last
        return "WITH RECURSIVE " + ", ".join([*(f"{n} AS ({known[n]})" for n in order), select.removeprefix("WITH RECURSIVE ")])
    head = ", ".join(f"{n} AS ({known[n]})" for n in order)
    return f"WITH {head} {select}" if head else select
