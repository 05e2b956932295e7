"""Centroid clusters, ranked search and personal data against plain loops on small fixtures."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from tidemark.llm import centroids, lexical, private

VECTORS = "vec_id long, embedding array<float>, cluster string, distance long"


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    means = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[0] is None, r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, m), n) for n, m in enumerate(means))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for n in range(len(means)):
            own = [v for (_, v), c in zip(kept, of, strict=True) if c == n]
            if own:
                means[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted((str(i), near(v)[1], near(v)[0]) for i, v in kept), means


@pytest.mark.parametrize("copies", [0, 300])
def test_clusters_by_plain_loops(spark, copies):
    r = random.Random(copies)
    rows = [(n, [r.gauss(0, 0.3) for _ in range(6)]) for n in range(80)] + [(5, [0.5] * 6)] * copies
    rows += [(None, [0.1] * 6), (7, [-0.25] * 6), (7, [-0.25] * 6), (90, None), (91, []), (92, [0.1] * 5), (93, [0.1] * 5 + [None]), (94, [0.1] * 5 + [float("nan")]), (95, [float("inf")] * 6), (96, [1e30] * 6), (97, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS).repartition(5)
    want, means = plain_clusters([x for x in rows if x[0] != 96], 9, 4, 6)  # 96 is beyond what a long can hold
    out, got = centroids.cluster(df, k=9, rounds=4, dims=6)
    assert got.tolist() == means
    assert sorted((str(x.vec_id), x.cluster, x.distance) for x in out.collect()) == want
    full = centroids.with_inertia(out, got).collect()
    for x in full:
        assert x.cluster_inertia == sum(d for _, c, d in want if c == x.cluster) and x.inertia == sum(d for *_, d in want)
        assert x.centroid_sha256 == hashlib.sha256(",".join(map(str, means[x.cluster])).encode()).hexdigest()


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5], "x", 1), (2, [0.0, -0.5], "x", 1)], VECTORS)
    out, means = centroids.cluster(df, k=5, rounds=2, dims=2)
    assert len(means) == 2 and [x.distance for x in out.collect()] == [0, 0]
    none, means = centroids.cluster(df.limit(0), k=5, rounds=2, dims=2)
    assert centroids.with_inertia(none, means).count() == 0 and len(means) == 0


def test_dictionaries_lose_nothing():
    x = np.random.default_rng(1).integers(-3, 3, (500, 7))
    x[100:400] = x[100]
    subvectors, codes = centroids.dictionaries(x)
    assert np.array_equal(np.hstack([v[c] for v, c in zip(subvectors, codes.T, strict=True)]), x)
    assert max(v.shape[1] for v in subvectors) > 1  # copies make wide blocks


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranks(docs, items, k):
    held = [(i, plain_terms(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n, length = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, w in held:
            m = 75 + (25 * len(w) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 12 * m)) for t in plain_terms(text) if t in w)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("leaf", "tree", "block"), [(32, 16_384, 200_000), (2, 50, 40)])
def test_ranks_by_plain_loops(spark, monkeypatch, leaf, tree, block):
    r = random.Random(7)
    words = [f"w{n}" for n in range(60)] + ["É", "Straße", "漢字", "X9"]
    text = lambda n: " ".join(r.choice(words[: r.randint(3, 64)]) + r.choice(["", ",", ".", "_"]) for _ in range(n))
    docs = [(n, text(r.randint(1, 60))) for n in range(150)] + [(200, None), (201, ""), (202, " .,- "), (None, text(20)), (3, text(30)), (205, text(5000))]
    docs += [(300 + n, "w1 w2 w3 w4 same text É") for n in range(60)]
    items = [(n, text(12)) for n in range(12)] + [(50, None), (51, ""), (52, "unknown words only"), (53, "w1 w1 w1 É"), (53, "w1 w1 w1 É"), (54, "W2 x9"), (54, "w3")]
    monkeypatch.setattr(lexical, "LEAF", leaf)
    monkeypatch.setattr(lexical, "TREE_DOCS", tree)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string").repartition(4)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    got = sorted(((x.item_id, x["rank"], x.doc_id, x.score) for x in lexical.ranked(df, asked, 20, block).collect()), key=str)
    assert got == plain_ranks(docs, items, 20)
    assert lexical.ranked(df.limit(0), asked).count() == 0 and lexical.ranked(df, asked.limit(0)).count() == 0


def plain_base(text):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            double = [int(c) * (1 + n % 2) for n, c in enumerate(reversed(d))]
            fine = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(d) <= 19 and sum(x // 10 + x % 10 for x in double) % 10 == 0, "phone": 9 <= len(d) <= 15}
            if fine[kind]:
                out.append((kind, *m.span()))
    return sorted(out)


def test_base_spans_are_the_patterns(monkeypatch):
    r = random.Random(3)
    for _ in range(20_000):
        text = "".join(r.choice("1 2@.a-+()0bé") for _ in range(r.randint(0, 45)))
        assert sorted(private.base_spans(text)) == plain_base(text), text
    long = "a" * 200_000 + "1" * 200_000 + "@" + "+" * 1000
    assert private.base_spans(long) == [] and len(private.nodes(long)) == 1


def field(seed=2):
    r = np.random.default_rng(seed)
    return private.Field(r.normal(size=(private.FEATURES, private.LABELS)) * 0.3, r.normal(size=(2, private.LABELS, private.LABELS)) * 0.4)


def all_assignments(f, g):
    """Marginals by adding up all assignments."""
    n, out = len(g.text), np.zeros((len(g.text), private.LABELS))
    unary = g.x @ f.shapes
    for labels in itertools.product(range(private.LABELS), repeat=n):
        if any(h and h != x for h, x in zip(g.label, labels, strict=True)):
            continue
        w = sum(unary[k, x] for k, x in enumerate(labels)) + sum(f.pairs[kind][labels[a], labels[b]] for kind, e in enumerate(g.edges) for a, b in e)
        out[range(n), labels] += math.exp(w)
    return out / out.sum(axis=1, keepdims=True)


def test_messages_give_the_marginals():
    f = field()
    tree = private.graph(["12 34 x 777 y (777) z 5.5"], [[]])
    assert sum(map(len, tree.edges)) == 2
    assert np.abs(f.marginals(tree) - all_assignments(f, tree)).max() < 1e-4
    held = private.graph(["a@b.com 34 x 777 777 y (777)"], [private.base_spans("a@b.com 34 x 777 777 y (777)")])
    assert np.abs(f.marginals(held) - all_assignments(f, held)).max() < 0.03  # a loop: nearly
    # a document's marginals don't depend on the others of its batch
    both = private.graph(["12 34 x 777 y (777) z 5.5", "a@b.com 34 x 777 777 y (777)"], [[], private.base_spans("a@b.com 34 x 777 777 y (777)")])
    assert np.allclose(f.marginals(both), np.vstack([f.marginals(tree), f.marginals(held)]))


SCHEMA = "doc_id long, text string, found string"


def test_distant_tokens_share_a_kind(spark):
    docs = spark.createDataFrame([(n, f"write a{n}@b.com or +1 (21{n % 10}) 555-{1000 + n} from 10.0.0.{n}", "x") for n in range(50)], SCHEMA)
    f = private.train(docs)
    texts = ["call +1 (312) 555-1234 now, or later (312) 555-1234 again", "call (312) 555-1234 now", "on 1994-05-06 of v1.2.3 we paid $4,000.00 at 12:30", "two 4111111111111111 5500005555555559 here, 4111111111111111", None, "", "word " * 3000 + "10.1.2.3"]
    rows = spark.createDataFrame([(n, t, "x") for n, t in enumerate(texts)] + [(None, texts[0], "y")], SCHEMA)
    got = {x.doc_id: x for x in private.find(rows, f).collect()}
    name = lambda x: [(s.kind, x.text[s.start : s.end], s.base) for s in x.found]
    assert name(got[0]) == name(got[None]) == [("phone", "+1 (312) 555-1234", True), ("phone", "(312) 555-1234", False)]
    assert name(got[2]) == [] and got[4].found == [] and got[5].found == [] and name(got[6]) == [("ip", "10.1.2.3", True)]
    assert [k for k, *_ in name(got[3])] == ["card"] * len(name(got[3]))
    assert private.find(rows.limit(0), f).count() == 0 and private.find(rows, f).columns == ["doc_id", "text", "found"]
    out = private.find(rows, f).withColumn("text", private.redacted(private.F.col("text"), private.F.col("found"))).where("doc_id = 0").first()
    assert out.text == "call <phone> now, or later <phone> again"
    assert private.train(rows.limit(0)).shapes.shape == (private.FEATURES, private.LABELS)


def test_many_copies_have_few_links():
    text = "5551234567 and " * 3000
    g = private.graph([text], [[]])
    assert len(g.edges[1]) == 2999 and len(g.edges[0]) == 0
    assert private.found_in([text], field())[0] is not None
