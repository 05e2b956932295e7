"""Queries of markets and similarity, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import sqltext as S
from tidemark.functions.shared import spread
from tidemark.operators import markets, similarity
from tidemark.plans.oracle import STEPS, oracle
from tidemark.plans.risk_queries import SQL4, R4

_text = "lower(concat_ws(' ', coalesce(filename, ''), coalesce(subject, ''), coalesce(text, '')))"
_words = lambda text, ks: "least(10, " + " + ".join(f"CASE WHEN contains({text}, '{k}') THEN {len(k.split())} ELSE 0 END" for k in ks) + ")"
AXES = {"geography": ("geo_text", markets.GEOGRAPHY), "industry": ("full_text", markets.INDUSTRY), "line": ("full_text", markets.LINE)}
STEPS["market_words"] = "SELECT *, " + ", ".join(f"{_words(x, ks)} AS {axis}_{n}" for axis, (x, table) in AXES.items() for n, ks in enumerate(table.values())) + f" FROM (SELECT *, {_text} AS full_text, {_text} || coalesce(' ' || CASE WHEN contains(sender, '@') THEN string_split(sender, '@')[-1] END, '') AS geo_text FROM slips)"
_best = lambda axis, table: "CASE " + " ".join(f"WHEN {axis}_{n} = greatest({', '.join(f'{axis}_{k}' for k in range(len(table)))}) THEN '{name}'" for n, name in enumerate(table)) + " END"
_most = lambda axis, table: f"greatest({', '.join(f'{axis}_{k}' for k in range(len(table)))})"
STEPS["market_full"] = f"""
    SELECT *, (geography_words + industry_words + line_words) / 30.0::DOUBLE AS overall, CASE WHEN geography_words > 0 THEN geography ELSE 'unknown' END AS geography_or_unknown, CASE WHEN geography_words >= 3 THEN geography ELSE 'unknown' END AS geo_group,
           CASE WHEN industry_words >= 3 THEN industry ELSE 'other' END AS industry_group, CASE WHEN line_words >= 3 THEN line ELSE 'other' END AS line_group, array_to_string({S.hits('full_text', markets.INDICATORS)}, '|') AS indicators
    FROM (SELECT *, {', '.join(f"{_best(a, t)} AS {a}, {_most(a, t)} AS {a}_words" for a, (_, t) in AXES.items())} FROM market_words)"""
STEPS["market_long"] = " UNION ALL ".join(f"SELECT doc_id, uploaded_at, filename, '{c}' AS market_type, {c} AS market FROM market_full" for c in ("geo_group", "industry_group", "line_group"))
STEPS["slip_entities"] = "SELECT *, list_filter([regexp_extract(text, 'Insured: ([^\\n]+)', 1), regexp_extract(text, 'Cedant: ([^\\n]+)', 1), regexp_extract(text, 'Broker: ([^\\n]+)', 1)], lambda x: x <> '') AS entities FROM slips"
STEPS["vector_pairs"] = "SELECT a.vec_id // 20 AS block, a.vec_id AS v1, b.vec_id AS v2, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id // 20 = b.vec_id // 20 AND a.vec_id < b.vec_id"
_cosine = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
STEPS["all_near"] = f"SELECT a.vec_id AS v1, b.vec_id AS v2, {_cosine} AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_cosine} >= 0.4"
STEPS["slip_vectors"] = "SELECT application_id, doc_id, entities[1:CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END] AS entities, embedding FROM slip_entities LEFT JOIN (SELECT * FROM embeddings WHERE vec_id < 100) ON doc_id % 100 = vec_id AND doc_id % 3 > 0"
STEPS["word_sets"] = "SELECT doc_id, list_sort(list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))) AS w FROM documents"
STEPS["word_classes"] = "SELECT w, min(doc_id) AS class_id, len(w) AS n FROM word_sets WHERE len(w) > 0 GROUP BY w"
STEPS["word_links"] = "SELECT a.class_id AS c1, b.class_id AS c2 FROM word_classes a JOIN word_classes b ON a.class_id < b.class_id AND 100 * least(a.n, b.n) >= 95 * greatest(a.n, b.n) WHERE 100 * len(list_intersect(a.w, b.w)) >= 95 * (a.n + b.n - len(list_intersect(a.w, b.w)))"
#: Least cosine of pairs over the whole table, and of a greedy cluster; distance of density clusters.
PAIRS, NEAR, EPS = 0.45, 0.7, 0.3


def classified(t):
    return markets.classified(t.slips)


def entities(t):
    part = lambda label: F.regexp_extract("text", f"{label}: ([^\\n]+)", 1)
    return t.slips.withColumn("entities", F.filter(F.array(part("Insured"), part("Cedant"), part("Broker")), lambda x: x != ""))


def with_vectors(t):
    """Slips with subjects and texts that say little, of which two in three have a vector: pairs are kept by similarity alone, too."""
    slips = entities(t).select("application_id", "doc_id", F.lit("note").alias("subject"), F.lit("plain").alias("text"), F.slice("entities", 1, F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0)).alias("entities"))
    own = t.embeddings.select("vec_id", "embedding").where("vec_id < 100")
    return slips.join(own.hint("merge"), (F.pmod("doc_id", F.lit(100)) == F.col("vec_id")) & (F.col("doc_id") % 3 > 0), "left")


def vectors(t, size):
    return t.embeddings.withColumn("block", F.floor(F.col("vec_id") / size))


def prompts(t, kind):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text")) if kind else F.col("text")
    return t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("model"), text.alias("text"))


_set = "list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))"
STEPS["prompts_new"] = f"SELECT *, {_set} AS w FROM (SELECT doc_id AS id, lang AS model, CASE WHEN doc_id % 3 = 0 THEN text || ' more' ELSE text END AS text FROM documents)"
STEPS["prompts_known"] = f"SELECT doc_id AS known_id, lang AS model, text, {_set} AS w FROM documents"
STEPS["prompt_exact"] = "SELECT id, min(known_id) AS known_id, 'exact' AS kind FROM prompts_new n JOIN prompts_known k USING (model, text) GROUP BY 1"
STEPS["prompt_reuse"] = """
    SELECT * FROM prompt_exact UNION ALL
    SELECT id, min(known_id), 'near' FROM prompts_new n JOIN prompts_known k ON n.model = k.model AND len(n.w) > 0 AND 100 * least(len(n.w), len(k.w)) >= 95 * greatest(len(n.w), len(k.w))
    WHERE id NOT IN (SELECT id FROM prompt_exact) AND 100 * len(list_intersect(n.w, k.w)) >= 95 * (len(n.w) + len(k.w) - len(list_intersect(n.w, k.w))) GROUP BY 1"""


QUERIES = {
    "m1_market": lambda t: classified(t).select("doc_id", "geography", "geography_words", "industry", "industry_words", "line", "line_words", *R4("overall"), F.array_join("indicators", "|").alias("indicators")),
    "m2_text_domain": lambda t: t.slips.select("doc_id", F.length(markets.document_text("filename", "subject", "text")).alias("n_text"), markets.sender_domain("sender").alias("domain")),
    "m3_groups": lambda t: classified(t).select("doc_id", "geography_or_unknown", "geo_group", "industry_group", "line_group"),
    "m4_relations": lambda t: markets.relations(entities(t)).select("doc_id_1", "doc_id_2", "kind"),
    "m5_similar_pairs": lambda t: markets.relations(with_vectors(t)).select("doc_id_1", "doc_id_2", "kind", "common", F.round("similarity", 4).alias("similarity")),
    "m5_kept_pairs": lambda t: markets.relations(entities(t)).groupBy("block").agg(F.count(F.lit(1)).alias("pairs")),
    "j15_pairs": lambda t: t.slips.groupBy("application_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("application_id", F.expr("n * (n - 1) div 2").alias("pairs")),
    "u3_common_entities": lambda t: markets.relations(entities(t)).select("doc_id_1", "doc_id_2", "common"),
    "u4_entity_union": lambda t: entities(t).select("application_id", F.explode("entities").alias("e")).groupBy("application_id").agg(F.array_join(F.array_sort(F.collect_set("e")), "|").alias("entities")),
    "a7_distribution": lambda t: markets.distribution(classified(t)),
    "a8_members": lambda t: markets.members(classified(t)),
    "a8_groups": lambda t: markets.groups(classified(t)).select("market_type", "market", "n", "first_at", "last_at", "span_days", "kinds"),
    "a9_entities": lambda t: markets.repeated_entities(entities(t), "application_id", "entities"),
    "a10_trend": lambda t: markets.monthly_trend(t.slips).select("months", "first_n", "last_n", *R4("slope"), "direction"),
    "a11_growth": lambda t: markets.growth(classified(t), "industry_group").select("industry_group", "n", "days", *R4("per_month")),
    "a12_seasonal": lambda t: markets.seasonal(t.slips),
    "w3_top_markets": lambda t: markets.distribution(classified(t)).orderBy(F.desc("n"), "market").limit(10),
    "f9_market_filter": lambda t: markets.long_markets(classified(t)).where("market_type = 'industry_group' AND market = 'manufacturing'").select("doc_id"),
    "g1_near_texts": lambda t: similarity.near_texts(spread(t.documents)),
    "g2_cosine": lambda t: similarity.block_pairs(vectors(t, 20), "block").select("v1", "v2", F.round("cosine", 5).alias("cosine")),
    "g2_near_pairs": lambda t: similarity.near_members(t.embeddings, PAIRS).select("v1", "v2", F.round("cosine", 5).alias("cosine")),
    "g3_greedy_clusters": lambda t: similarity.greedy_clusters(vectors(t, 5), "block", NEAR).select("vec_id", "cluster"),
    "g4_density_clusters": lambda t: similarity.density_clusters(t.embeddings, EPS),
    "j18_prompt_reuse": lambda t: similarity.reused(prompts(t, 1), prompts(t, 0)).select("id", "known_id", "kind"),
}
_low2 = lambda c, ks: f"({S.has(f'lower(a.{c})', *ks)} OR {S.has(f'lower(b.{c})', *ks)})"
STEPS["slip_relations"] = f"""
    SELECT * FROM (SELECT a.application_id AS block, a.doc_id AS doc_id_1, b.doc_id AS doc_id_2, list_sort(list_distinct(list_intersect(a.entities, b.entities))) AS common,
        CASE WHEN {_low2('subject', markets.FOLLOW_UP)} THEN 'follow_up' WHEN len(list_distinct(list_intersect(a.entities, b.entities))) > 2 THEN 'same_client' WHEN {_low2('text', markets.BROKER)} THEN 'same_broker' WHEN {_low2('subject', markets.AMENDMENT)} THEN 'amendment' ELSE 'unrelated' END AS kind
    FROM slip_entities a JOIN slip_entities b ON a.application_id = b.application_id AND a.doc_id < b.doc_id) WHERE len(common) > 0 OR kind <> 'unrelated'"""
ORACLE = {
    "m1_market": f"SELECT doc_id, geography, geography_words, industry, industry_words, line, line_words, {SQL4('overall')}, indicators FROM market_full",
    "m2_text_domain": f"SELECT doc_id, length({_text}) AS n_text, string_split(sender, '@')[-1] AS domain FROM slips",
    "m3_groups": "SELECT doc_id, geography_or_unknown, geo_group, industry_group, line_group FROM market_full",
    "m4_relations": "SELECT doc_id_1, doc_id_2, kind FROM slip_relations",
    "m5_kept_pairs": "SELECT block, count(*) AS pairs FROM slip_relations GROUP BY 1",
    "j15_pairs": "SELECT application_id, n * (n - 1) // 2 AS pairs FROM (SELECT application_id, count(*) AS n FROM slips GROUP BY 1) WHERE n > 1",
    "u3_common_entities": "SELECT doc_id_1, doc_id_2, array_to_string(common, '|') AS common FROM slip_relations",
    "u4_entity_union": "SELECT application_id, string_agg(DISTINCT e, '|' ORDER BY e) AS entities FROM (SELECT application_id, unnest(entities) AS e FROM slip_entities) GROUP BY 1",
    "a7_distribution": "SELECT CASE market_type WHEN 'geo_group' THEN 'geo_' WHEN 'industry_group' THEN 'industry_' ELSE 'business_' END || market AS market, count(*) AS n FROM market_long GROUP BY 1",
    "a8_members": "SELECT market_type, market, doc_id FROM market_long",
    "m5_similar_pairs": f"""
    SELECT doc_id_1, doc_id_2, 'unrelated' AS kind, common, round(similarity, 4) AS similarity FROM (
      SELECT a.doc_id AS doc_id_1, b.doc_id AS doc_id_2, array_to_string(list_sort(list_distinct(list_intersect(a.entities, b.entities))), '|') AS common, coalesce({_cosine}, 0) AS similarity FROM slip_vectors a JOIN slip_vectors b ON a.application_id = b.application_id AND a.doc_id < b.doc_id) WHERE common <> '' OR similarity > 0.5""",
    "a8_groups": "SELECT market_type, market, n, first_at, last_at, span_days, kinds FROM (SELECT market_type, market, count(*) AS n, min(uploaded_at) AS first_at, max(uploaded_at) AS last_at, floor(epoch(max(uploaded_at) - min(uploaded_at)) / 86400)::BIGINT AS span_days FROM market_long GROUP BY 1, 2) JOIN (SELECT market_type, market, string_agg(k || ':' || c, '|' ORDER BY k || ':' || c) AS kinds FROM (SELECT market_type, market, string_split(filename, '.')[-1] AS k, count(*) AS c FROM market_long GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (market_type, market)",
    "a9_entities": "SELECT * FROM (SELECT application_id, entity, n, row_number() OVER (PARTITION BY application_id ORDER BY n DESC, entity) AS place FROM (SELECT application_id, entity, count(*) AS n FROM (SELECT application_id, unnest(entities) AS entity FROM slip_entities) GROUP BY 1, 2 HAVING count(*) > 1)) WHERE place <= 5",
    "a10_trend": "SELECT months, first_n, last_n, round(s, 4) AS slope, CASE WHEN s > 0 THEN 'increasing' WHEN s < 0 THEN 'decreasing' ELSE 'stable' END AS direction FROM (SELECT *, (last_n - first_n) / months AS s FROM (SELECT count(*) AS months, arg_min(n, m) AS first_n, arg_max(n, m) AS last_n FROM (SELECT strftime(uploaded_at, '%Y-%m') AS m, count(*) AS n FROM slips GROUP BY 1)))",
    "a11_growth": "SELECT industry_group, n, days, round(n / (days / 30), 4) AS per_month FROM (SELECT industry_group, count(*) AS n, floor(epoch(max(uploaded_at) - min(uploaded_at)) / 86400)::BIGINT AS days FROM market_full GROUP BY 1) WHERE n > 1 AND days > 0",
    "a12_seasonal": "SELECT m AS month, count(doc_id) AS n FROM (SELECT unnest(range(1, 13)) AS m) LEFT JOIN slips ON month(uploaded_at) = m GROUP BY 1",
    "w3_top_markets": "SELECT CASE market_type WHEN 'geo_group' THEN 'geo_' WHEN 'industry_group' THEN 'industry_' ELSE 'business_' END || market AS market, count(*) AS n FROM market_long GROUP BY 1 ORDER BY n DESC, market LIMIT 10",
    "f9_market_filter": "SELECT doc_id FROM market_full WHERE industry_group = 'manufacturing'",
    "g1_near_texts": "SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links FROM word_sets LEFT JOIN word_classes USING (w) LEFT JOIN (SELECT class_id, count(*) AS n_links FROM (SELECT c1 AS class_id FROM word_links UNION ALL SELECT c2 FROM word_links) GROUP BY 1) USING (class_id)",
    "g2_cosine": "SELECT v1, v2, round(cosine, 5) AS cosine FROM vector_pairs",
    "g2_near_pairs": f"SELECT v1, v2, round(cosine, 5) AS cosine FROM all_near WHERE cosine >= {PAIRS}",
    "g3_greedy_clusters": f"SELECT vec_id, coalesce((SELECT min(v1) FROM vector_pairs p WHERE p.v2 = e.vec_id AND p.v1 // 5 = p.v2 // 5 AND cosine > {NEAR}), vec_id) AS cluster FROM embeddings e",
    "j18_prompt_reuse": "SELECT id, known_id, kind FROM prompt_reuse",
    "g4_density_clusters": f"WITH RECURSIVE e AS (SELECT v1 AS a, v2 AS b FROM all_near WHERE 1 - cosine <= {EPS} UNION SELECT v2, v1 FROM all_near WHERE 1 - cosine <= {EPS}), r(n, m) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.n) SELECT vec_id, coalesce(c, -1) AS cluster FROM embeddings LEFT JOIN (SELECT n, min(m) AS c FROM r GROUP BY 1) ON n = vec_id",
}
ORACLE_SQL = {k: oracle(v) for k, v in ORACLE.items()}
