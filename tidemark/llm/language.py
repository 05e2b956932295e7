"""Language identification by Bayesian fusion of evidence.

Evidence of a page: the likelihood of its text under each language (hashed byte trigrams), the language that its markup
declares, its address suffix, and what the pages of its host, domain and suffix are written in. The last three are
priors by grouped aggregation of the texts' posteriors, each level smoothed by the one above (all pages, suffix,
domain, host); a page's own text doesn't count towards its host's prior. How far a declaration can be trusted is
learned in the same way.

The text model is fitted on a bounded sample of documents with a known language (SAMPLE_DOCS, by a digest of their
ids); all other counts are over all pages.

Cases: null or empty html has no text and declares nothing, so the priors decide; a page of several articles is judged
by the text of all of them, one without any by all its text; a null url, or one without a host,
belongs to the empty host; long texts count less than their length, as their trigrams depend on each other; ties go to
the language that comes first; repeated rows are judged each; without any labelled document the result is null; an
empty table gives an empty table; other columns pass through (columns of the results' names are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrow import flat_text, small_batches, wider, with_columns
from tidemark.llm.common import LOWER, UPPER, save

SAMPLE_DOCS, SLOT_BITS = 4000, 13
#: Trigrams count as so many at most; what a prior weighs, in pages, against the level below it.
ENOUGH, SMOOTH = 60.0, 4.0
OTHER = "?"

_LOW = np.arange(256, dtype=np.uint32)
_LOW[0x41:0x5B] += 32


def slots(flat: np.ndarray) -> np.ndarray:
    """The slot of the trigram that begins at each byte (the last two places are of no use)."""
    b = _LOW[flat]
    h = np.zeros(len(b), dtype=np.uint32)
    if len(b) > 2:
        h[:-2] = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
        h *= np.uint32(0x27D4EB2F)
    return h >> np.uint32(32 - SLOT_BITS)


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    weights: np.ndarray  # slot, language: log-likelihood


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> TextModel:
    """docs: doc_id, text, lang."""
    known = docs.where("lang is not null and text is not null")
    ids = known.select(F.col("doc_id").alias("chosen")).distinct().orderBy(F.xxhash64("chosen"), "chosen").limit(sample_docs)
    sample = known.join(F.broadcast(ids), F.col("doc_id") == F.col("chosen")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in small_batches(big, "text"):
                flat, offsets = flat_text(batch.column("text"))
                own, langs = slots(flat), np.array(batch.column("lang").to_pylist(), dtype=object)
                usable = np.ones(len(flat), dtype=bool)
                for k in (1, 2):
                    usable[(offsets[1:] - k)[np.diff(offsets) >= k]] = False
                for lang in sorted(set(langs)):
                    mine = np.repeat(langs == lang, np.diff(offsets)) & usable
                    n = np.bincount(own[mine], minlength=1 << SLOT_BITS)
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "slot", "n"])

    counts = sample.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()  # languages times slots at most
    languages = tuple(sorted(counts["lang"].unique()))
    table = np.full((1 << SLOT_BITS, len(languages)), 0.5)
    table[counts["slot"].to_numpy(dtype=int), counts["lang"].map({x: n for n, x in enumerate(languages)}).to_numpy(dtype=int)] += counts["n"].to_numpy(dtype=float)
    return TextModel(languages, np.log(table / table.sum(axis=0)))


def likelihoods(df: DataFrame, model: TextModel, text: str) -> DataFrame:
    """Adds evidence (array of double): the text's log-likelihood under each language, the best one at 0. Drops the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in small_batches(big, text):
                flat, offsets = flat_text(batch.column(text))
                own = slots(flat)
                rows = []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    n = max(0, b - a - 2)
                    total = np.bincount(own[a : a + n], minlength=1 << SLOT_BITS) @ model.weights if n else np.zeros(len(model.languages))
                    total = total / (1 + n / ENOUGH)
                    rows.append(total - total.max())
                out = batch.drop_columns([text])
                yield with_columns(out, {"evidence": pa.array(rows, pa.list_(pa.float64()))})

    return df.mapInArrow(run, wider(df.drop(text), [T.StructField("evidence", T.ArrayType(T.DoubleType()))]))


def visible(html: Column) -> Column:
    """The text of all articles, or else of the page, without markup."""
    whole = F.coalesce(html, F.lit(""))
    articles = F.array_join(F.regexp_extract_all(whole, F.lit(r"(?is)<article\b.*?</article\s*>"), F.lit(0)), " ")
    text = F.coalesce(F.nullif(articles, F.lit("")), whole)
    for pattern in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>", r"&[#a-zA-Z0-9]{1,10};"):
        text = F.regexp_replace(text, pattern, " ")
    return text


def declared(html: Column) -> Column:
    """The two or three letters of the html element's lang, or null."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?i)<html\b[^>]*?\slang\s*=\s*["']?([a-z]{2,3})""", 1)), F.lit(""))


def host_levels(url: Column) -> tuple[Column, Column, Column]:
    """Host, domain (its last two labels) and suffix (its last label)."""
    host = F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(?:[^/?#@]*@)?([^/?#:]*)", 1), UPPER, LOWER)
    return host, F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def identify(pages: DataFrame, model: TextModel, url: str = "url", html: str = "html") -> DataFrame:
    """Adds lang, confidence, text_lang (by the text alone) and declared. Drops nothing but the html."""
    many = range(len(model.languages))
    if not many:
        return pages.drop(html).withColumns({"lang": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "text_lang": F.lit(None).cast("string"), "declared": declared(F.col(html))})
    names = F.array(*map(F.lit, model.languages))
    softmax = lambda x: F.transform(x, lambda v: F.exp(v - F.array_max(x)) / F.aggregate(x, F.lit(0.0), lambda a, w: a + F.exp(w - F.array_max(x))))
    host, domain, suffix = host_levels(F.col(url))
    said = declared(F.col(html))
    rows = pages.select(*(c for c in pages.columns if c != html), host.alias("_host"), domain.alias("_domain"), suffix.alias("_suffix"), said.alias("declared"), visible(F.col(html)).alias("_text"))
    rows = likelihoods(rows, model, "_text").withColumn("_said", F.when(F.col("declared").isin(*model.languages), F.col("declared")).when(F.col("declared").isNotNull(), OTHER))
    rows = save(rows, "lang-evidence")
    soft = rows.withColumn("p", softmax(F.col("evidence")))

    def sums(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.array(*(F.sum(F.get("p", F.lit(k))) for k in many)).alias("p"))

    # how declarations go with languages: as many rows as languages, and two
    said_rows = {r["_said"]: r["p"] for r in sums(soft, "_said").collect()}
    total = [sum(p[k] for p in said_rows.values()) for k in many]
    trust = lambda s: F.array(*(F.lit(float(np.log((said_rows[s][k] + 0.5) / (total[k] + 0.5 * len(said_rows))))) for k in many))
    by_said = F.lit([0.0] * len(many))
    for s in said_rows:
        if s is not None:
            by_said = F.when(F.col("_said") == s, trust(s)).otherwise(by_said)

    # priors from the top down
    hosts = save(sums(soft, "_suffix", "_domain", "_host"), "lang-hosts")
    domains = sums(hosts, "_suffix", "_domain")
    suffixes = sums(domains, "_suffix")
    everything = sum(total) + len(many)
    smooth = lambda own, above: F.transform(F.arrays_zip(own.alias("c"), above.alias("u")), lambda z: (z["c"] + SMOOTH * z["u"]) / (F.aggregate(own, F.lit(0.0), lambda a, v: a + v) + SMOOTH))
    top = F.lit([float((t + 1) / everything) for t in total])
    suffixes = suffixes.select("_suffix", smooth(F.col("p"), top).alias("above"))
    domains = domains.join(suffixes.hint("merge"), "_suffix").select("_suffix", "_domain", smooth(F.col("p"), F.col("above")).alias("above"))
    priors = hosts.join(domains.hint("merge"), ["_suffix", "_domain"]).select("_host", F.col("p").alias("_counts"), F.col("above").alias("_above"))
    priors = save(priors, "lang-priors")

    both = rows.join(priors.hint("merge"), "_host")  # a hot host is split by the engine
    others = F.transform(F.arrays_zip(F.col("_counts").alias("c"), softmax(F.col("evidence")).alias("p")), lambda z: F.greatest(z["c"] - z["p"], F.lit(0.0)))
    both = both.withColumn("_prior", smooth(others, F.col("_above")))
    fused = F.transform(F.arrays_zip(F.col("evidence").alias("e"), by_said.alias("d"), F.col("_prior").alias("h")), lambda z: z["e"] + z["d"] + F.log(z["h"]))
    both = both.withColumn("_fused", fused).withColumn("_post", softmax(F.col("_fused")))
    pick = lambda x: F.get(names, F.array_position(x, F.array_max(x)).cast("int") - 1)
    out = both.withColumn("lang", pick(F.col("_post"))).withColumn("confidence", F.array_max("_post")).withColumn("text_lang", F.when(F.array_min("evidence") < 0, pick(F.col("evidence"))))
    kept = [c for c in pages.columns if c not in (html, "lang", "confidence", "text_lang", "declared")]
    return out.select(*kept, "lang", "confidence", "text_lang", "declared")
