"""The queries of the corpus operators, each over its whole table, and the SQL that some of them can be held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, centroids, chunks, gam, language, lexical, mixing, nearest, neardup, private, rules, secrets, urls
from tidemark.llm.common import count_words, new_path, read, save

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    path = vocabulary_path()
    coded = bpe.decode(bpe.encode(docs, path).drop("text"), path)
    return coded.select(
        "doc_id", "n_tokens", F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = gam.train(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = gam.score(docs, model)
    held_out = F.coalesce(gam.remainder("doc_id") == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    of, base = rules.features("text"), ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    order = [e.rule for e in rules.estimate(docs, given=tuple(base))]  # the result holds these for every text
    counted = docs.select("doc_id", "text", *(of[c].alias(c) for c in base))
    judged = rules.judge(counted, order, of | {c: F.col(c) for c in base})
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *base, failed.alias("base_failed"), "kept")


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM p),
r AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY rid),
f AS (SELECT d.doc_id, len(w.w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_capitals, len(l) AS n_lines
      FROM d JOIN w USING (rid) LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 20 * n_symbols > word_chars OR 2 * n_capitals > word_chars OR 10 * n_dup_lines > 3 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM b
"""

MIX_SEED = "mix-1"


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    found = secrets.scan(docs, secrets.Ledger(spark, new_path(spark, "secret-ledger")))
    base = F.filter("found", lambda x: x["no"] < 3)
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("path").alias("doc_id"), count("assign"), count("access"), count("hex"),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("found")).alias("spans"),
    )


def _op4_sql() -> str:
    found = " UNION ALL ".join(
        f"""SELECT rid, {n} AS no, '{r.kind}' AS kind, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s, length(m[i]) AS n
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, regexp_extract_all(text, $p${r.pattern}$p$) AS m, regexp_extract_all(text, $p${r.pattern}$p$, {r.group}) AS c, string_split_regex(text, $p${r.pattern}$p$) AS g FROM d))
        WHERE length(c[i]) >= {r.least}"""
        for n, r in enumerate(secrets.RULES)
    )
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    f AS (SELECT rid, no, kind, s::BIGINT AS s, (s + n)::BIGINT AS e FROM ({found})),
    a AS (SELECT rid, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
          string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) FILTER (no < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) AS spans FROM f GROUP BY rid)
    SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN a USING (rid)"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", count_words("text").alias("size"), mixing.order_key("doc_id", MIX_SEED).alias("key"))
    sized = save(docs, "mix-sized")
    mixed = mixing.apply(sized, mixing.plan(sized))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('{MIX_SEED}:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM s),
o AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                / sum(w) OVER (ORDER BY cap::DOUBLE / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM w),
l AS (SELECT max(level) AS level FROM o),
t AS (SELECT source, source_size, CASE WHEN cap < l.level * w THEN cap::DOUBLE ELSE l.level * w END AS target FROM w, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target - whole * source_size ELSE 0 END AS part FROM p),
c AS (SELECT d.*, source_size, target, whole, part, sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN part > 0 AND 2 * before + size <= 2 * part THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    judged = urls.judge(pages, urls.train(urls.labelled(spark)))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, percent=85).withColumn("kept", F.col("doc_id") == F.col("component_id"))


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id),
k AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN k USING (doc_id)
"""

def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.spans(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("later")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.train(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return language.identify(pages, model).select("page_id", "lang", "confidence", "text_lang", "declared")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=20, every=20)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, means = centroids.cluster(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return centroids.with_inertia(found, means)


def _op11_sql() -> str:
    k, rounds = centroids.CLUSTERS, centroids.ROUNDS
    out = f"""
    WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor({centroids.SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings
               WHERE len(embedding) = {centroids.DIMS} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
    p AS MATERIALIZED (SELECT rid, unnest(range({centroids.DIMS})) AS i, unnest(x) AS x FROM v),
    s AS (SELECT rid, row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), vec_id IS NULL, x) - 1 AS c FROM v),
    c0 AS (SELECT c, i, x FROM s JOIN p USING (rid) WHERE c < {k})"""
    for r in range(rounds + 1):
        out += f""",
    d{r} AS (SELECT rid, c, sum((p.x - m.x) * (p.x - m.x))::BIGINT AS d FROM p JOIN c{r} m USING (i) GROUP BY rid, c),
    a{r} AS MATERIALIZED (SELECT rid, c, d FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d, c) AS n FROM d{r}) WHERE n = 1)"""
        if r < rounds:
            out += f""",
    m{r} AS (SELECT c, i, floor(sum(x) / count(*))::BIGINT AS x FROM a{r} JOIN p USING (rid) GROUP BY c, i),
    c{r + 1} AS MATERIALIZED (SELECT c, i, coalesce(m.x, o.x) AS x FROM c{r} o LEFT JOIN m{r} m USING (c, i))"""
    return out + f""",
    h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)
    SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
    FROM a{rounds} JOIN v USING (rid) JOIN h USING (c)"""


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark").select("item_id", "text")
    return lexical.ranked(read(spark, sf_dir, "documents").select("doc_id", "text"), items)


OP12_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{lexical.TERM}') AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM t),
d AS (SELECT rid, doc_id, 100 - 25 + ((25 * len(w) * n) // l)::BIGINT AS m FROM t, s WHERE len(w) > 0),
f AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM t) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s),
b AS (SELECT row_number() OVER () AS bid, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{lexical.TERM}') AS q FROM benchmark),
q AS (SELECT bid, item_id, term, count(*) AS many FROM (SELECT bid, item_id, unnest(q) AS term FROM b) GROUP BY ALL),
r AS (SELECT bid, item_id, rid, doc_id, sum(many * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN f USING (term) JOIN d USING (rid) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY bid ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 20
"""

def op13_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = private.find(docs, private.train(docs)).drop("text")
    base = F.filter("found", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("found", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, private.KINDS), F.sha2(private.listed(base), 256).alias("base_sha256"), private.listed(F.col("found")).alias("spans"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_quality_rules": op2_quality_rules,
    "op3_language": op3_language,
    "op4_secret_scans": op4_secret_scans,
    "op5_mixing": op5_mixing,
    "op6_url_filters": op6_url_filters,
    "op7_neighbours": op7_neighbours,
    "op8_bpe": op8_bpe,
    "op9_minhash": op9_minhash,
    "op10_substrings": op10_substrings,
    "op11_centroids": op11_centroids,
    "op12_lexical": op12_lexical,
    "op13_private": op13_private,
}
ORACLE_SQL: dict[str, str] = {"op2_quality_rules": OP2_SQL, "op4_secret_scans": _op4_sql(), "op5_mixing": OP5_SQL, "op9_minhash": OP9_SQL, "op11_centroids": _op11_sql(), "op12_lexical": OP12_SQL}
