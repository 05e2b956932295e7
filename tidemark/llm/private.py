"""Personal data: patterns, and a skip-chain conditional random field over what they leave open.

The patterns of four kinds find the base spans. Nodes of the field are the tokens (runs without spaces) that hold a digit
or an @; all other tokens are observed as clean. A node has potentials of its shape; neighbours with one space between
them share a chain potential; and distant tokens that repeat, or are alike (the same digits or address in another
dress), share one skip potential: every occurrence is linked with the next one of its key, so a number that stands a
thousand times in a text has as many links, not their square. Tokens of base spans are held at their kinds; ROUNDS rounds
of loopy message passing carry that to the rest of the document, all documents of a batch at once. Tokens that come out
as a kind with a probability of CONFIDENCE or more become added spans, unless they touch a base span.

All potentials are fitted together by pseudo-likelihood, on at most SAMPLE_DOCS documents with the base spans as labels
and on invented clean numerals (CLEAN), so that what only looks like a number of its kind stays clean.

Cases: null and empty texts have no spans; texts of any length are used whole, in time that grows with their length;
places are code points, end exclusive; rows that repeat are judged each, alike; an empty table gives an empty table (and
the model is fitted on the invented numerals alone); all other columns pass through, and one of the result's name (found)
is replaced. A document's result depends on its own text and the model only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrow import small_batches, wider, with_columns

KINDS = ("email", "ip", "card", "phone")
#: Label 0 is clean; the kinds follow.
LABELS = 1 + len(KINDS)
#: Documents and characters of a document that the field is fitted on at most.
SAMPLE_DOCS, SAMPLE_CHARS = 2000, 20_000
ROUNDS, DAMPING, CONFIDENCE = 20, 0.5, 0.9
#: Steps and decay of the fit, and the share of tokens whose shape it does not see.
STEPS, RATE, DECAY, HIDDEN = 300, 0.1, 1e-4, 0.5
#: Digits that a key needs at least.
KEY_DIGITS = 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SPACE = frozenset(" \t\n\x0b\x0c\r")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match takes whole runs of digits, so none begins inside one
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NODE = re.compile(r"[0-9@][^\x20\x09-\x0D]*")
_EDGE = re.compile(r"[^A-Za-z0-9+(]*([A-Za-z0-9+(].*?)[^A-Za-z0-9)]*", re.DOTALL)

Span = tuple[str, int, int]


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    each = [int(c) for c in reversed(number)]
    return (sum(each[::2]) + sum(sum(divmod(2 * d, 10)) for d in each[1::2])) % 10 == 0


def is_ip(match: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in match.split(".")))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, without those that fail its test."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:  # the local part is the run before the @, as far as no match holds it
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            done = domain.end()
            out.append(("email", begin, done))
        else:
            done = max(done, at + 1)  # no match goes over this @
        at = text.find("@", done)
    out += [("ip", *m.span()) for m in _IP.finditer(text) if is_ip(m.group())]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 12 <= len(d := digits(m.group())) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return out


def nodes(text: str) -> list[tuple[int, int]]:
    """Tokens that hold a digit or an @."""
    out, done = [], 0
    for m in _NODE.finditer(text):
        begin = m.start()
        while begin > done and text[begin - 1] not in _SPACE:
            begin -= 1
        done = m.end()
        out.append((begin, done))
    return out


#: Shapes of a token's core (the token without punctuation at its edges).
SHAPES = tuple(
    re.compile(p)
    for p in (
        r".*", r".*@.*", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+", r"[0-9]+(-[0-9]+)+", r"[0-9]{3}-[0-9]{4}", r"\+[0-9]+.*", r"\([0-9]+\).*", r"\([0-9]{3}\)", r"[0-9]+(\.[0-9]+)+",
        r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"[0-9]+([.,][0-9]+)?", r".*[A-Za-z].*", r".*[=/:,$%#].*", r"[0-9]{4}-[0-9]{2}-[0-9]{2}.*", r"[0-9]{1,4}[/.][0-9]{1,2}[/.][0-9]{1,4}", r".*[^\x00-\x7F].*",
    )
)
#: Upper ends of the ranges of how many digits a core has.
MANY = (0, 2, 4, 6, 8, 11, 15, 19)
FEATURES = len(SHAPES) + len(MANY) + 5


def core(token: str) -> tuple[int, int]:
    m = _EDGE.fullmatch(token) if len(token) < 200 else None
    return m.span(1) if m else (0, len(token))


def shape(own: str) -> list[int]:
    if len(own) > 200:  # no number or address of these kinds is so long; one feature tells
        return [1] + [0] * (FEATURES - 2) + [1]
    d = digits(own)
    few = [len(d) <= n for n in MANY]
    buckets = [b and not a for a, b in zip([False, *few], few, strict=False)]
    card = 12 <= len(d) <= 19
    ip = bool(SHAPES[10].fullmatch(own))
    tests = [card and luhn(d), card and not luhn(d), ip and is_ip(own), ip and not is_ip(own), not few[-1]]
    return [int(x) for x in (*(bool(p.fullmatch(own)) for p in SHAPES), *buckets, *tests)]


def key(own: str) -> str:
    """What tokens that are alike have in common; empty: linked with none."""
    if "@" in own:
        return own.lower()
    d = digits(own)
    return d if len(d) >= KEY_DIGITS else ""


@dataclass
class Graph:
    """Tokens of some texts. label: of a base span, else 0. Edges: two nodes each, by kind (chain, skip)."""

    text: list[int]
    begin: list[int]
    end: list[int]
    x: np.ndarray
    label: np.ndarray
    edges: tuple[np.ndarray, np.ndarray]


def graph(texts: list[str], base: list[list[Span]]) -> Graph:
    owner, begin, end, label, x = [], [], [], [], []
    edges: tuple[list, list] = ([], [])
    for n, (text, spans) in enumerate(zip(texts, base, strict=True)):
        seen: dict[str, int] = {}
        places = sorted((a, b, KINDS.index(k) + 1) for k, a, b in spans)
        k = last = 0
        for a, b in nodes(text):
            here = len(owner)
            low, high = core(text[a:b])
            low, high, own = a + low, a + high, text[a + low : a + high]
            while k < len(places) and places[k][1] <= a:
                k += 1
            of = next((p for p in places[k : k + len(KINDS)] if p[0] < b and a < p[1]), None)
            if last and owner[-1] == n and a - last == 1:
                edges[0].append((here - 1, here))
            name = key(own)
            if name:
                if name in seen:
                    edges[1].append((seen[name], here))
                seen[name] = here
            owner.append(n)
            begin.append(low)
            end.append(high)
            label.append(of[2] if of else 0)
            x.append(shape(own))
            last = b
    both = tuple(np.array(e, dtype=np.int64).reshape(-1, 2) for e in edges)
    return Graph(owner, begin, end, np.array(x, dtype=float).reshape(-1, FEATURES), np.array(label, dtype=np.int64), both)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Field:
    """Potentials: of shapes (FEATURES x LABELS), and of the two kinds of edges (LABELS x LABELS: first, second token)."""

    shapes: np.ndarray
    pairs: np.ndarray

    def marginals(self, g: Graph) -> np.ndarray:
        """Probabilities of the labels of each node, by message passing in both directions of all edges at once."""
        own = g.x @ self.shapes
        held = g.label > 0
        own[held] = -50.0
        own[held, g.label[held]] = 0.0
        a = np.concatenate([np.r_[e[:, 0], e[:, 1]] for e in g.edges])
        b = np.concatenate([np.r_[e[:, 1], e[:, 0]] for e in g.edges])
        if not len(a):
            return softmax(own)
        potential = np.concatenate([np.repeat(np.stack([p, p.T]), len(e), axis=0) for p, e in zip(self.pairs, g.edges, strict=True)])
        sizes = [len(e) for e in g.edges]
        back = np.concatenate([s + np.r_[n + np.arange(n), np.arange(n)] for s, n in zip(np.r_[0, np.cumsum(sizes)[:-1]] * 2, sizes, strict=True)])
        message = np.zeros((len(a), LABELS))
        for _ in range(ROUNDS):
            belief = own.copy()
            np.add.at(belief, b, message)
            sent = (belief[a] - message[back])[:, :, None] + potential
            top = sent.max(axis=1)
            new = top + np.log(np.exp(sent - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            message = DAMPING * message + (1 - DAMPING) * new
        belief = own.copy()
        np.add.at(belief, b, message)
        return softmax(belief)


def fit(g: Graph) -> Field:
    """Pseudo-likelihood: each label given its shape and the labels of its neighbours; gradient steps with moments. The shape of every other token (by a fixed draw) is hidden but for the first feature, so that edges learn to tell what shapes would."""
    y, x = np.eye(LABELS)[g.label], g.x.copy()
    x[np.random.default_rng(20240614).random(len(x)) < HIDDEN, 1:] = 0
    theta = np.zeros((FEATURES + 2 * LABELS, LABELS))
    at = [FEATURES + n * LABELS for n in range(2)]
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    n = max(1, len(y))
    for step in range(1, STEPS + 1):
        logits = x @ theta[:FEATURES]
        for k, e in zip(at, g.edges, strict=True):
            pair = theta[k : k + LABELS]
            np.add.at(logits, e[:, 1], pair[g.label[e[:, 0]]])
            np.add.at(logits, e[:, 0], pair.T[g.label[e[:, 1]]])
        wrong = softmax(logits) - y
        slope = np.zeros_like(theta)
        slope[:FEATURES] = x.T @ wrong
        for k, e in zip(at, g.edges, strict=True):
            slope[k : k + LABELS] = y[e[:, 0]].T @ wrong[e[:, 1]] + wrong[e[:, 0]].T @ y[e[:, 1]]
        slope = slope / n + DECAY * theta
        slope[at[1] :] = (slope[at[1] :] + slope[at[1] :].T) / 2  # skip links have no direction
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field(theta[:FEATURES], theta[FEATURES:].reshape(2, LABELS, LABELS))


#: Formats of clean numerals; a 9 stands for any digit.
CLEAN = (
    "9", "99", "999", "9999", "99999", "9.9", "99.9", "9.9.9", "99.99", "9999-99-99", "99/99/9999", "99.99.9999", "99:99", "99:99:99", "9999-9999", "999-9999", "(9999)", "(999)", "(9)", "$9.99", "$9,999", "99%", "9.9%", "#9999", "v9.9.9", "9x9",
    "9999999", "99999999", "9999999999", "999-999", "99-99", "999-9-99-999999-9", "a9999", "@aaaa", "aa99aa", "9999999999999999999999",
)


#: Numbers that are private in full, and again in short.
REPEATED = (("+9 (999) 999-9999", "(999) 999-9999"), ("+99 999 999-9999", "999 999-9999"), ("+9 999-999-9999", "999-999-9999"))


def invented(many: int = 40) -> list[tuple[str, list[Span]]]:
    """Invented texts of clean numerals between words, some numerals twice, and of numbers that come again in short."""
    random = np.random.default_rng(20240613)

    def one(form: str) -> str:
        return "".join(str(random.integers(1, 10)) if c == "9" else c for c in form)

    out: list[tuple[str, list[Span]]] = []
    for n in range(many):
        some = [one(CLEAN[k]) for k in random.permutation(len(CLEAN))]
        out += [(" and ".join([*some, *some[:8]]), []), (" ".join(some), [])]
        full, short = REPEATED[n % len(REPEATED)]
        number = one(full)
        again = number[len(full) - len(short) :]
        text = f"{number} and {some[0]} or {again} and {some[1]}"
        at = text.index(again, len(number))
        out.append((text, [("phone", 0, len(number)), ("phone", at, at + len(again))]))
    return out


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """docs: text. Fitted on the documents of the least digests that hold a digit or an @; digests are read first, so tasks send no texts but those that are taken."""
    some = docs.select("text").where(F.col("text").rlike("[0-9@]") & (F.length("text") <= SAMPLE_CHARS)).withColumn("digest", F.xxhash64("text"))
    least = [r["digest"] for r in some.select("digest").orderBy("digest").limit(sample_docs).collect()]
    taken = some.where(F.col("digest") <= least[-1]).select("text").distinct().collect() if least else []  # bounded: SAMPLE_DOCS texts of SAMPLE_CHARS
    texts = sorted(r["text"] for r in taken)
    more, spans = zip(*invented(), strict=True)
    return fit(graph([*texts, *more], [*map(base_spans, texts), *spans]))


def added_spans(text: str, base: list[Span], tokens: list[tuple[int, int, int]]) -> list[Span]:
    """tokens: begin, end, label of those that came out as a kind, in order. Parts of a phone number with one space between them are one span."""
    joined: list[list[int]] = []
    for begin, end, label in tokens:
        if joined and label == joined[-1][2] == 1 + KINDS.index("phone") and begin - joined[-1][1] == 1:
            joined[-1][1] = end
        else:
            joined.append([begin, end, label])
    taken, out, k = sorted((a, b) for _, a, b in base), [], 0
    reach = 0
    for begin, end, label in joined:
        while k < len(taken) and taken[k][0] < end:
            reach = max(reach, taken[k][1])
            k += 1
        own = text[begin:end]
        if reach <= begin and (label != 1 + KINDS.index("phone") or 7 <= len(digits(own)) <= 15):
            out.append((KINDS[label - 1], begin, end))
    return out


FOUND = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def found_in(texts: list[str], field: Field) -> list[list[dict]]:
    base = [base_spans(t) for t in texts]
    g = graph(texts, base)
    more: list[list] = [[] for _ in texts]
    if len(g.text):
        p = field.marginals(g)
        best = p.argmax(axis=1)
        for k in np.flatnonzero((best > 0) & (p.max(axis=1) >= CONFIDENCE) & (g.label == 0)):
            more[g.text[k]].append((g.begin[k], g.end[k], int(best[k])))
    out = []
    for text, own, tokens in zip(texts, base, more, strict=True):
        both = [(s, True) for s in own] + [(s, False) for s in added_spans(text, own, tokens)]
        both.sort(key=lambda x: (x[0][1], KINDS.index(x[0][0])))
        out.append([{"kind": k, "start": a, "end": b, "base": f} for (k, a, b), f in both])
    return out


def find(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """docs with found: kind, start, end, base (of a pattern) of all spans, by start, then kind."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
    some = re.compile("[0-9@]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in small_batches(big, text, rows=4096):
                texts = [t or "" for t in batch.column(text).to_pylist()]
                held = [k for k, t in enumerate(texts) if some.search(t)]
                found: list = [[] for _ in texts]
                for k, f in zip(held, found_in([texts[k] for k in held], field), strict=True):
                    found[k] = f
                yield with_columns(batch, {"found": pa.array(found, kind)})

    return docs.mapInArrow(run, wider(docs, [T.StructField("found", T._parse_datatype_string(FOUND))]))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(text: Column, found: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; of spans that overlap, the first is named."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    mark = lambda a, s: F.when(s["start"] >= a["at"], F.concat(F.lit("<"), s["kind"], F.lit(">"))).otherwise("")
    step = lambda a, s: F.struct(F.concat(a["out"], text.substr(a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), mark(a, s)).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))
    return F.aggregate(found, start, step, lambda a: F.concat(a["out"], text.substr(a["at"] + 1, F.length(text))))
