"""Values worked out by hand from the formulas."""

import datetime as dt
import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import consolidate, decision, extract, limits, loss, markets, metrics, premium, risk, similarity
from tidemark.sources import files


def events(spark):
    day = dt.datetime(2020, 1, 1)
    rows = [("1", day + dt.timedelta(days=n), Decimal(a), c) for n, a, c in ((30, 50000, "Fire"), (180, 25000, "Theft"), (365, 100000, "Flood"), (500, 75000, "Equipment failure"))]
    return spark.createDataFrame([*rows, ("2", day, Decimal(10), "Fire")], "application_id string, event_date timestamp, amount decimal(15,2), cause string")


def params(spark):
    rows = [("1", Decimal(25_000_000), Decimal(20_000_000), "Industrial Manufacturing", "California, USA", "manufacturing", "Steel and concrete", "Manufacturing facility"), ("2", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "application_id string, asset_value decimal(15,2), coverage_limit decimal(15,2), asset_type string, location string, industry_sector string, construction_type string, occupancy string")


def fin(spark):
    rows = [("1", Decimal(10_000_000), Decimal(50_000_000), Decimal(20_000_000), "A", "A+"), ("2", None, None, None, None, None)]
    return spark.createDataFrame(rows, "application_id string, revenue decimal(15,2), assets decimal(15,2), liabilities decimal(15,2), credit_rating string, financial_strength_rating string")


def apps(spark):
    return spark.createDataFrame([("1",), ("2",), ("3",)], "application_id string")


def test_loss(spark):
    r = {x.application_id: x for x in loss.loss_stats(events(spark)).collect()}
    a = r["1"]
    assert (a.total, a.largest, a.mean, a.median) == (250000, 100000, 62500, 62500)
    assert a.std == pytest.approx(27950.8497) and a["skew"] == pytest.approx(0) and a.kurtosis == pytest.approx(-1.36) and a.p95 == pytest.approx(96250)
    assert a.years == pytest.approx(1.286790, abs=1e-6) and a.annual == pytest.approx(194281.9149) and a.frequency == pytest.approx(3.108511, abs=1e-6) and a.volatility == pytest.approx(0.447214, abs=1e-6)
    assert r["2"].volatility == 0
    t = {x.application_id: x for x in loss.loss_trend(events(spark)).collect()}["1"]
    assert t.slope == pytest.approx(100.396689) and t.r == pytest.approx(0.641581, abs=1e-6) and t.p == pytest.approx(0.358419, abs=1e-6) and t.trend == "stable"
    full = {x.application_id: x for x in loss.loss_analysis(apps(spark), events(spark)).collect()}
    assert full["1"].loss_confidence == pytest.approx(0.411923, abs=1e-6) and full["1"].loss_score == pytest.approx(44.501514, abs=1e-6)
    assert full["3"].loss_score == 10 and full["3"].loss_confidence == 0 and full["3"].trend == "stable"


@pytest.mark.parametrize("df,t", [(1, 12.706), (2, 4.303), (5, 2.571), (10, 2.228), (30, 2.042)])
def test_p_value(spark, df, t):
    r = t / (df + t * t) ** 0.5
    assert spark.range(1).select(loss.p_value(F.lit(r), F.lit(df + 2))).first()[0] == pytest.approx(0.05, abs=2e-4)


def test_risk_and_decision(spark):
    cat = {x.application_id: x for x in risk.catastrophe_exposure(params(spark)).collect()}
    assert (cat["1"].zone, cat["1"].perils, cat["1"].mitigations) == ("very_high", ["earthquake", "wildfire"], ["Fire-resistant construction", "Industrial safety protocols"])
    assert cat["1"].cat_score == pytest.approx(13.94) and cat["1"].pml == 19_500_000 and cat["1"].concentration == pytest.approx(0.8) and cat["1"].cat_confidence == pytest.approx(1)
    assert cat["2"].zone == "moderate" and cat["2"].perils == ["flood"] and cat["2"].pml == 0
    f = {x.application_id: x for x in risk.financial_strength(fin(spark)).collect()}
    assert (f["1"].debt_to_asset, f["1"].equity_ratio, f["1"].asset_turnover, f["1"].revenue_to_debt) == (0.4, 0.6, 0.2, 0.5)
    assert (f["1"].financial_score, f["1"].rating, f["1"].credit_risk, f["1"].financial_confidence) == (63, "BBB", "MEDIUM", 1)
    assert f["2"].financial_confidence == pytest.approx(0.3) and "No credit rating available for assessment" in f["2"].financial_concerns
    all_risk = risk.overall_risk(apps(spark), events(spark), params(spark), fin(spark))
    r = {x.application_id: x for x in all_risk.collect()}["1"]
    assert (r.overall_score, r.risk_level, r.risk_confidence) == (64.23, "HIGH", 0.793)
    none = spark.createDataFrame([], "application_id string, n int")
    d = {x.application_id: x for x in decision.decided(all_risk, none).collect()}["1"]
    assert [round(x.score, 3) for x in d.factors] == [35.77, 75.6, 40.528, 0, 100, 85, 70, 79]
    assert d.total == pytest.approx(52.1117, abs=1e-4) and d.decision == "CONDITIONAL" and d.variance == pytest.approx(936.41, abs=0.01) and d.confidence == pytest.approx(0.65325, abs=1e-5)
    assert len(d.terms) == 3 and d.premium_adjustment == pytest.approx(0.1423)
    hit = spark.createDataFrame([("1", 1)], "application_id string, n int")
    assert {x.application_id: x for x in decision.decided(all_risk, hit).collect()}["1"].decision == "REJECT"
    assert sum(decision.WEIGHTS.values()) == pytest.approx(1) and sum(risk.WEIGHTS.values()) == pytest.approx(1)


def test_limits(spark, monkeypatch):
    from tidemark.sources.adapters import VIEWS

    p = spark.createDataFrame([("1", Decimal(75_000_000), Decimal(50_000_000), "x", "Houston, Texas, USA", "petrochemical manufacturing", "steel and concrete", "chemical processing"), ("2", Decimal(150_000_000), None, None, None, None, None, None)], params(spark).schema)
    f = spark.createDataFrame([("1", None, Decimal(1_000_000_000), Decimal(300_000_000), "BBB+", None), ("2", None, Decimal(1_000_000_000), Decimal(300_000_000), None, None)], fin(spark).schema)
    found = limits.violations(p, f, spark.sql(VIEWS["business_limits"]))
    rows = {(x.application_id, x.limit_type, x.severity) for x in found.collect()}
    assert rows == {("1", "catastrophe_exposure", "WARNING"), ("2", "asset_value", "ERROR")}
    passed = {x.application_id: x.passed for x in limits.summary(p, found).collect()}
    assert passed == {"1": True, "2": False}
    monkeypatch.setattr(limits, "BLOCK_LIMITS", 3)  # in blocks of three or so
    blocks = limits.violations(p, f, spark.sql(VIEWS["business_limits"]))
    assert {(x.application_id, x.limit_type, x.severity) for x in blocks.collect()} == rows and blocks.count() == 2
    assert "CartesianProduct" not in blocks._jdf.queryExecution().toString()


def test_markets(spark):
    rows = [(1, "a.pdf", "New York office property", "fire building", "x@example.com"), (2, "b.pdf", "London Singapore marine cargo", "hull vessel shipping", None), (3, "c.pdf", "hello", "nothing", "no at sign")]
    docs = spark.createDataFrame([(i, dt.datetime(2024, 1, i), f, s, t, m) for i, f, s, t, m in rows], "doc_id long, uploaded_at timestamp, filename string, subject string, text string, sender string")
    r = {x.doc_id: x for x in markets.classified(docs).collect()}
    assert (r[1].geography, r[1].geography_words, r[1].geo_group) == ("north_america", 2, "unknown")
    assert r[2].geography == "europe" and r[2].line == "marine"
    assert (r[3].geography, r[3].geography_words, r[3].geography_or_unknown) == ("north_america", 0, "unknown")
    assert [x[0] for x in docs.orderBy("doc_id").select(markets.sender_domain("sender")).collect()] == ["example.com", None, None]


@pytest.mark.parametrize("text,value,least", [("PML: 25%", 25, 0.8), ("Maximum Probable Loss 12.75 percent", 12.75, 0.8), ("the loss (PML) is estimated at 15.5% of the sum", 15.5, 0.8), ("The PML is 8.5%", 8.5, 0.8), ("Estimated Maximum Loss: 30%", 30, 0.6), ("PML: 150%", 100, 0.3), ("none", None, 0)])
def test_pml(spark, text, value, least):
    r = extract.pml(spark.createDataFrame([(text,)], "text string")).first()
    assert r.pml == value and r.pml_confidence >= least and (text != "PML: 150%" or r.pml_confidence < 0.5)


def test_premium(spark):
    row = (1, "A", "USD", 5e6, 125000.0, None, 15.0, 5000.0, 2000.0, 20.0, 75000.0, 25000.0, 10000.0, 120000.0)
    rows = spark.createDataFrame([row], "row_id long, insured_name string, currency string, tsi double, premium double, premium_rate double, brokerage double, taxes double, levies double, accepted_share double, paid_losses double, outstanding_reserves double, recoveries double, earned_premium double")
    rates = spark.createDataFrame([("KES", 1.0), ("USD", 150.0)], "currency string, kes_value double")
    r = premium.derived(rows, rates).first()
    assert (r.rate_percent, r.rate_permille, r.incurred, r.loss_ratio, r.accepted_premium, r.accepted_liability, r.accepted_loss_ratio) == (2.5, 25, 90000, 75, 25000, 1_000_000, 75)
    assert (r.tsi_kes, r.premium_kes, r.net_premium, r.liability, r.risk_score) == (750_000_000, 18_750_000, 99250, "Low", 5.5)


def test_merge_is_idempotent(spark):
    rows = spark.createDataFrame([(1, "R", None, "x", 0.5, "a"), (2, "R", "Fire", "y", 0.0, "b"), (3, None, "Flood", None, 0.3, "c")], "row_id long, reference_number string, perils string, insured_name string, confidence_score double, source_document string")
    out = {x.merge_key: x for x in consolidate.merged_slips(rows, ["perils", "insured_name"]).collect()}
    assert out["r:R"].perils == "Fire" and out["r:R"].insured_name == "x" and out["r:R"].sources == "a|b" and out["r:R"].confidence == 0.5
    assert out["u:3"].perils == "Flood"


def test_plan_is_a_permutation(spark):
    docs = spark.createDataFrame([("m", n, k, c, q, c >= 0.3, f"f{n}") for n, (k, c, q) in enumerate([("facultative", 0.9, 0.5), ("placement", 0.9, 0.7), (None, 0.2, 0.1), (None, 0.0, 0.0), ("treaty", 0.5, 0.9)])], "message string, i int, kind string, confidence double, quality double, is_slip boolean, filename string")
    assert [x.i for x in extract.plan(docs, "message", "i").orderBy("place").collect()] == [1, 0, 4, 2, 3]


def test_clusters(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.9, 0.1], 0), (2, [0.0, 1.0], 0), (3, [0.0, 1.0], 0), (4, [-1.0, 0.0], 0)], "vec_id long, embedding array<double>, block int")
    assert {x.vec_id: x.cluster for x in similarity.density_clusters(v).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: -1}
    assert {x.vec_id: x.cluster for x in similarity.greedy_clusters(v, "block").collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


def test_short_prompts_are_reused(spark):
    from types import SimpleNamespace

    from tidemark.plans import market_queries

    many = " ".join(f"w{k}" for k in range(30))
    rows = [(1, "short text", "en"), (2, "short text", "en"), (4, "short text", "de"), (3, many, "en"), (5, None, "en"), (7, "", "en")]
    t = SimpleNamespace(documents=spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    found = {(r.id, r.known_id, r.kind) for r in market_queries.QUERIES["j18_prompt_reuse"](t).collect()}
    assert found == {(1, 1, "exact"), (2, 1, "exact"), (3, 3, "near"), (4, 4, "exact"), (7, 7, "exact")}


def test_files(spark, tmp_path):
    (tmp_path / "kenya").mkdir()
    (tmp_path / "kenya" / "res_exposure.csv").write_text("REPL;BUILD;OCCUPANCY\n10;1;a\n20;x;b\n")
    df = files.read_csv(spark, str(tmp_path / "kenya"))
    assert df.columns == ["REPL", "BUILD", "OCCUPANCY"]
    assert files.exposure_totals(df).first().asDict() == {"replacement_cost": 30, "buildings": 1, "area": 0}
    assert files.csv_tree(spark, str(tmp_path), "Kenya", r".*exposure.*\.csv$").count() == 2
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "b.pdf").write_bytes(b"MZ")
    got = {x.path.rpartition("/")[2]: x for x in files.scanned(spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(str(tmp_path))).collect()}
    assert got["a.pdf"].errors == [] and got["b.pdf"].errors == ["content does not fit the extension", "executable content"]


def test_keyword_tables_are_whole(spark):
    """Texts and what is expected of them are stated here, apart from the operators' tables."""
    texts = ["Casualty treaty, cat xl layer, for a logistics and pharmaceutical group; MPL is 12.5% of the sum; smoke and riot", "working xl on aerospace, volcanic eruption", "surety", "nothing of the kind"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    r = {x.doc_id: x for x in extract.pml(extract.labelled_fields(docs)).collect()}
    assert [r[k].coverage for k in range(4)] == ["casualty", None, "surety", None]
    assert [r[k].treaty for k in range(4)] == ["cat xl", "working xl", None, None]
    assert [r[k].occupation for k in range(4)] == ["logistics", "aerospace", None, None]
    assert r[0].peril_words == "riot|smoke" and r[1].peril_words == "volcanic eruption"
    assert (r[0].pml, r[3].pml) == (12.5, None)


def test_topics(spark):
    text = "x" * 100 + " The NAT CAT zone has flood \n and   storm surge per the RMS model. " + "y" * 400
    docs = spark.createDataFrame([(1, text), (2, "quiet"), (3, None)], "doc_id int, text string")
    out = {x.doc_id: x for x in extract.topic(docs, "cat", ["nat cat", "flood", "storm surge", "model"], 30, 150, 300, [(["rms", "air"], 1, 0.15)]).collect()}
    low, parts = text.lower(), []
    for word in ("nat cat", "flood", "storm surge"):
        at = low.find(word)
        parts.append(text[max(0, at - 30) : at + 150].strip())
    want = " ".join("; ".join(parts).split())
    assert out[1].cat == want[:297] + "..." and out[1].cat_confidence == pytest.approx(0.95)
    assert out[2].cat is None and out[3].cat is None and out[2].cat_confidence == 0


@pytest.mark.parametrize("given", ["02/29/2024", "29/02/2024", "2024-02-29", "02-29-2024", "29-02-2024", "2024/02/29", "29 Feb 2024", "29 February 2024", "Feb 29, 2024"])
def test_nine_date_forms(spark, given):
    got = spark.createDataFrame([(given,), ("30 Feb 2024",)], "given string").select(extract.parsed_date(F.col("given")).alias("d")).collect()
    assert [x.d for x in got] == [dt.datetime(2024, 2, 29), None]


def test_encodings_delimiters_and_trees(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "latin.csv").write_bytes("id;name\n1;Peña\n2;Ünal\n".encode("latin-1"))
    (tmp_path / "a" / "utf.csv").write_bytes("id|name\n1|Peña\n".encode())
    read = lambda name: [(x.id, x.name) for x in files.read_csv(spark, str(tmp_path / "a" / name)).collect()]
    assert read("latin.csv") == [("1", "Peña"), ("2", "Ünal")] and read("utf.csv") == [("1", "Peña")]
    for folder, name, text in (("South Africa", "exposure_summary.csv", "x,y\n1,2\n"), ("south-africa", "adm1.csv", "x;z\n3;4\n"), ("Kenya", "summary.csv", "x,y\n5,6\n"), ("South Africa", "notes.csv", "x,y\n7,8\n")):
        (tmp_path / "tree" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / folder / name).write_text(text)
    tree = files.csv_tree(spark, str(tmp_path / "tree"), "South Africa")
    assert sorted((x.x, x.y, x.z) for x in tree.collect()) == [("1", "2", None), ("3", None, "4")]
    assert files.csv_tree(spark, str(tmp_path / "tree"), "Peru").count() == 0


def test_near_vectors_are_all_found(spark):
    import numpy as np

    r = np.random.default_rng(3)
    x = r.standard_normal((300, 16))
    x[100:140] = x[:40] + 0.3 * r.standard_normal((40, 16))
    x[200] = x[201] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16)]
    classes, members = similarity.vector_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    own = [i for i in range(300) if i not in (200, 201)]
    want = {(a, b) for a in own for b in own if a < b and y[a] @ y[b] >= 0.7}
    assert {(p.a, p.b) for p in similarity.near_vectors(classes, 0.7, 0.9999).collect()} == want and len(want) >= 35
    assert {m.vec_id: m.class_id for m in members.collect()}[201] == 7 and members.count() == 300


def test_truncation_skips_what_does_not_fit(spark):
    """Of 100 characters 30 stay from the head, 20 from the tail, and 50 of the best sections between them."""
    head, tail = "h" * 30, "t" * 20
    parts = ["plain " + "a" * 14, "key " + "b" * 36, "key " + "c" * 16, "key d", "e"]  # 20, 40, 20, 5 and 1 characters
    text = head + "\n\n".join(parts) + tail
    rows = [(1, text), (2, "short"), (3, None), (4, ""), (5, "x" * 100), (6, "y" * 101)]
    got = {r.doc_id: r.truncated for r in extract.truncated(spark.createDataFrame(rows, "doc_id long, text string"), ["key"], 100).collect()}
    assert got[1] == "\n\n".join([head, parts[1], parts[3], parts[4], tail])  # the third doesn't fit after the second, later ones do
    assert got[2] == "short" and got[3] == got[4] == "" and got[5] == "x" * 100
    assert got[6] == "y" * 30 + "\n\n" + "\n\n" + "y" * 20  # one section of 51 characters fits nowhere


def test_corpus_lists_but_does_not_read_long_files(spark, tmp_path):
    kinds = [(["pdf"], "pdf", 20, "25504446"), (["csv"], "csv", 40, "")]
    files_ = {"a.pdf": b"%PDF-1", "b.pdf": b"%PDF-" + b"x" * 30, "c.csv": b"x" * 41, "e.csv": b"1;<ScRiPt src", "f.csv": b"\xff\x00 VBSCRIPT:go", "g.exe": b"MZ..", "h.pdf": b"no pdf", "in/i.csv": b"Data:Text/HTML,"}
    for name, content in files_.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r.path.rpartition("/")[2]: (r.length, r.digest, r.errors) for r in files.corpus(spark, str(tmp_path), kinds=kinds, security_bytes=40).collect()}
    assert {k: v[2] for k, v in got.items()} == {
        "a.pdf": [], "b.pdf": ["file too large"], "c.csv": ["file too large", "beyond the security limit"], "e.csv": ["suspicious pattern <script"], "f.csv": ["suspicious pattern vbscript:"],
        "g.exe": ["type not allowed", "executable content"], "h.pdf": ["content does not fit the extension"], "i.csv": ["suspicious pattern data:text/html"],
    }
    assert got["c.csv"][:2] == (41, None) and got["a.pdf"][1] == hashlib.sha256(b"%PDF-1").hexdigest()
    plan = files.corpus(spark, str(tmp_path), kinds=kinds)._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length,40)" in plan  # the source drops long files before it opens them


def test_near_vectors_of_several_lengths(spark):
    rows = [(n, [1.0, 0.1 * n, 0.0]) for n in range(8)] + [(20, [1.0, 0.0, 0.0, 0.0]), (21, [1.0, 0.1, 0.0, 0.0]), (30, [float("inf"), 1.0, 1.0]), (31, [1e308, 1e308, 1.0]), (32, [None, 1.0, 1.0]), (33, [])]
    classes, _ = similarity.vector_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(p.a, p.b) for p in similarity.near_vectors(classes, 0.9, 0.9999).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    plain = dict(rows[:10])
    assert got == {(a, b) for a in plain for b in plain if a < b and len(plain[a]) == len(plain[b]) and cos(plain[a], plain[b]) >= 0.9} and (20, 21) in got


def test_percentiles_of_many_points(spark):
    import numpy as np

    r = np.random.default_rng(5)
    values = {"a": r.standard_normal(30_000), "b": np.r_[np.full(20_000, 7.0), r.random(9000) * 1e9, [-1e300, 1e300]], "c": r.integers(0, 3, 25_000).astype(float), "d": np.array([4.0]), "e": r.random(10_001)}
    rows = [(k, float(v)) for k, x in values.items() for v in x] + [("f", None), (None, 2.0), (None, 4.0)]
    got = {x.metric: x for x in metrics.metric_stats(spark.createDataFrame(rows, "metric string, value double"), "metric").collect()}
    for k, x in values.items():
        assert (got[k].n, got[k].least, got[k].most) == (len(x), x.min(), x.max())
        assert np.allclose([got[k].p50, got[k].p95, got[k].p99], np.percentile(x, [50, 95, 99]), rtol=1e-12)
    assert (got["f"].n, got["f"].p50) == (0, 0.0) and (got[None].n, got[None].p50) == (2, 3.0) and len(got) == 7
    assert metrics.metric_stats(spark.createDataFrame(rows, "metric string, value double")).first().n == len(rows) - 1


def test_relations_by_similarity_alone_and_in_a_large_block(spark, monkeypatch):
    from tidemark.functions import joins

    rows = [(n, "big" if n % 3 == 0 else f"b{n % 20}", "note", "plain", [f"e{n % 7}"] if n % 2 else [], [1.0, float(n % 5), 0.0] if n % 4 else None) for n in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, application_id string, subject string, text string, entities array<string>, embedding array<double>")
    got = {(r.doc_id_1, r.doc_id_2): r for r in markets.relations(df).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5 if a and b else 0.0
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and (set(a[4]) & set(b[4]) or cos(a[5], b[5]) > 0.5)}
    assert set(got) == want and any(not r.common and r.kind == "unrelated" for r in got.values())
    monkeypatch.setattr(joins, "HOT_ROWS", 10)
    assert joins.hot_keys(df, "application_id") == ["big"]
    assert {(r.doc_id_1, r.doc_id_2) for r in markets.relations(df).collect()} == want


def test_a_word_of_many_sets_is_dealt_to_many_tasks(spark, monkeypatch):
    from tidemark.functions import joins

    rows = [(n, "common " + " ".join(f"w{(n * 7 + k) % 90}" for k in range(40 if n % 3 else 1))) for n in range(240)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: frozenset((t or "").split()) for i, t in rows}
    first = {}
    for i, s in sorted(sets.items()):
        first.setdefault(s, i)
    near = {(a, b) for s, a in first.items() for t, b in first.items() if a < b and s and t and 100 * len(s & t) >= 90 * len(s | t)}
    want = {i: (first[s] if s else i, sum(first[s] in p for p in near) if s else 0) for i, s in sets.items()}
    plain = {r.doc_id: (r.class_id, r.n_links) for r in similarity.near_texts(df, 90).collect()}
    monkeypatch.setattr(joins, "HOT_ROWS", 10)
    salted = {r.doc_id: (r.class_id, r.n_links) for r in similarity.near_texts(df, 90).collect()}
    assert plain == salted == want and any(n for _, n in want.values())
    # the largest task of the salted join holds no more than a few times what the others do
    left = df.where("text <> ''").select(F.lit("common").alias("word"), "doc_id")
    dealt = joins.salted_join(left, left.withColumnRenamed("doc_id", "other"), "word", ["common"], F.col("doc_id"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 240 * 240 and len(sizes) >= 6 and max(sizes) <= 5 * sorted(sizes)[len(sizes) // 2]


def test_no_near_vector_is_missed_between_groups(spark, monkeypatch):
    """At a low cosine, where buckets by random planes leave some of many pairs out; in several groups and blocks."""
    import numpy as np

    x = np.random.default_rng(5).standard_normal((3000, 16))
    classes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "class_id long, embedding array<double>")
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(int(a), int(b)) for a, b in np.argwhere(np.triu(y @ y.T, 1) >= 0.45)}
    monkeypatch.setattr(similarity, "GROUP", 1000)
    monkeypatch.setattr(similarity, "STEP", 256)
    got = [(p.a, p.b) for p in similarity.near_vectors(classes, 0.45).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100_000


def test_pairs_of_copies_are_given(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [0.9, 0.1])]
    got = sorted((p.v1, p.v2, round(p.cosine, 5)) for p in similarity.near_members(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9).collect())
    near = round(0.9 / (0.82**0.5), 5)
    assert got == [(0, 1, near), (0, 2, 1.0), (0, 4, 1.0), (0, 7, near), (1, 2, near), (1, 4, near), (1, 7, 1.0), (2, 4, 1.0), (2, 7, near), (4, 7, near)]


def test_period_means_do_not_depend_on_the_order_of_rows(spark):
    """A mean of eight scores that ends in half a ten-thousandth: sums of doubles come out above or below it, as rows come."""
    import functools
    import operator
    import random

    r = random.Random(3)
    scores = [30.45, 33.6, 54.05, 39.0, 34.64, 32.41, 37.49, 32.09]  # sum 293.73, mean 36.71625
    orders = [r.sample(scores, 8) for _ in range(200)]
    assert len({functools.reduce(operator.add, o) for o in orders}) > 1  # sum() makes up for it
    at = dt.datetime(2024, 1, 1)
    rows = [(at + dt.timedelta(days=k), "APPROVE", at + dt.timedelta(days=k, hours=1), x, 0.1) for k, o in enumerate(orders) for x in o] + [(at - dt.timedelta(days=1), None, None, None, float("nan"))]
    df = spark.createDataFrame(rows, "created_at timestamp, decision string, decided_at timestamp, overall_score double, premium_adjustment double").coalesce(1)
    got = {}
    for r in metrics.metric_trends(df, "day").where(F.col("period") >= F.lit(at)).collect():
        got.setdefault(r.metric, set()).add((r.value, r.n))
    assert got["risk_scores"] == {(36.71625, 8)} and got["premium_adjustments"] == {(0.1, 8)} and got["processing_time"] == {(1.0, 8)}
    empty = {r.metric: r.value for r in metrics.metric_trends(df, "day").where(F.col("period") < F.lit(at)).collect()}
    assert empty["risk_scores"] is None and empty["processing_time"] is None and empty["premium_adjustments"] != empty["premium_adjustments"]


def test_prefixes_are_made_where_sets_are_read(spark):
    """No word is shuffled to be sorted, and no link is lost by sums that hold several words, places or kinds."""
    import random

    r = random.Random(11)
    base = [[f"w{r.randrange(400)}" for _ in range(r.randrange(1, 60))] for _ in range(60)]
    texts = [" ".join(w) for w in base for _ in range(3)]
    texts = [t if k % 3 == 0 else " ".join(x for x in t.split() if r.random() > 0.08 * (k % 3)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {k: frozenset(t.split()) for k, t in enumerate(texts)}
    least = {s: min(k for k, x in sets.items() if x == s) for s in set(sets.values()) if s}
    near = {s: sum(s != x and 100 * len(s & x) >= 80 * len(s | x) for x in least) for s in least}
    assert {x.doc_id: (x.class_id, x.n_links) for x in similarity.near_texts(df, 80).collect()} == {k: (least.get(s, k), near.get(s, 0)) for k, s in sets.items()}
    assert sum(near.values()) > 40
    hashed = df.select("doc_id", similarity.word_set("text").alias("w")).select("doc_id", F.size("w").alias("n"), similarity.hashes("w").alias("h"))
    assert "Exchange" not in similarity.prefixes(hashed, ["doc_id"], 80)._jdf.queryExecution().executedPlan().toString()


def test_reuse_makes_no_pairs_of_copies(spark, monkeypatch):
    """Sixty copies asked and sixty known are one pair; the least near one is found behind others that are not near, and for ids that stand in several rows."""
    import random

    counts, kept = {}, similarity.saved
    monkeypatch.setattr(similarity, "saved", lambda df, name: counts.setdefault(name, []).append((out := kept(df, name)).count()) or out)
    words = [f"w{k}" for k in range(30)]
    schema = "id long, model string, text string"
    new = spark.createDataFrame([(k, "m", " ".join(random.Random(k).sample([*words, "new"], 31))) for k in range(60)], schema)
    known = spark.createDataFrame([(100 + k, "m", " ".join(random.Random(k).sample(words, 30))) for k in range(60)], schema)
    assert {(x.id, x.known_id, x.kind) for x in similarity.reused(new, known).collect()} == {(k, 100, "near") for k in range(60)}
    assert counts["reuse-pairs"] == [1]

    r = random.Random(7)
    base = [[f"v{r.randrange(120)}" for _ in range(r.randrange(1, 40))] for _ in range(40)]
    some = lambda k: " ".join(x for x in base[r.randrange(40)] if r.random() > 0.04 * (k % 4))
    rows = [(r.randrange(500), r.choice(["m", "n", None]), r.choice([some(k), some(k), None])) for k in range(800)]
    asked, held = rows[:400], rows[400:]
    sets = lambda x: frozenset((x or "").split())
    exact = {}
    for i, m, t in asked:
        exact.setdefault(i, set()).update(k for k, n, u in held if m is not None and t is not None and (m, t) == (n, u))
    want = {(i, min(k), "exact") for i, k in exact.items() if k}
    near = {}
    for i, m, t in asked:
        a = sets(t)
        near.setdefault(i, set()).update(k for k, n, u in held if a and m is not None and m == n and 100 * len(a & sets(u)) >= 80 * len(a | sets(u)))
    want |= {(i, min(k), "near") for i, k in near.items() if k and not exact[i]}
    counts.clear()
    got = similarity.reused(*(spark.createDataFrame(x, schema) for x in (asked, held)), 80)
    assert sorted(tuple(x) for x in got.select("id", "known_id", "kind").collect()) == sorted(want)
    assert len(want) > 30 and len(counts["reuse-turn"]) > 1


def test_sets_that_pairs_do_not_name_are_not_sent(spark):
    """However many are named."""
    sets = spark.range(0, 400_000).withColumnRenamed("id", "class_id")
    pairs = spark.range(0, 240_000, 2).select(F.col("id").alias("c1"), (F.col("id") + 1).alias("c2"))
    found = similarity.needed(sets, "class_id", pairs, "c1")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("class_id < 240000 AND class_id % 2 = 0").count() == 120_000 and found.count() < 125_000
