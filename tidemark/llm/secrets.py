"""Secret scans with an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger holds which (blob, rule version) pairs
have been scanned and what was found; a run scans only pairs that it lacks, one text a blob, appends to the ledger, and
joins the findings back to all paths. A changed rule gets a new version and so is scanned again, the others are not.

Cases: a null text is the empty blob, without findings; a null path keeps its row; copies share one scan; repeated
rows stay; texts of any length are scanned whole; a text's matches may be any number (they are rows, not one array in
one step); an empty table gives an empty table; `scan` gives path, blob and found, and keeps no other columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import save


@dataclass(frozen=True)
class SecretRule:
    """least: a match counts if its group has that many characters at least. hint: a string that any match contains."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    hint: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}/{self.version}"


def any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: In the order in which kinds are listed; the first three are the base.
RULES = (
    SecretRule("assign", 1, "(" + "|".join(any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    SecretRule("access", 1, "AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    SecretRule("hex", 1, "[0-9a-f]{24,}"),
    SecretRule("private_key", 1, "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    SecretRule("host_token", 1, "gh[pousr]_[A-Za-z0-9]{30,}", hint="gh"),
    SecretRule("chat_token", 1, "xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
    SecretRule("signed_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
)

SCANNED, FOUND = "blob string, rule string", "blob string, rule string, start int, end int"
#: Findings are broadcast to the paths up to so many blobs and spans in all (a blob takes about 150 bytes, a span 60: 45 MB).
MANY_BLOBS, MANY_SPANS = 100_000, 500_000


def blob(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


class Ledger:
    """Two tables in one folder: pairs scanned, and findings. Findings are written first, so a run that breaks off between the two is simply done again; equal rows count once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._table("scanned", SCANNED)

    def found(self) -> DataFrame:
        return self._table("found", FOUND)

    def append(self, found: DataFrame, scanned: DataFrame) -> None:
        found.write.mode("append").parquet(f"{self.path}/found")
        scanned.write.mode("append").parquet(f"{self.path}/scanned")


def spans(texts: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """texts: blob, text, todo (keys of rules). Findings as rows; places in code points, end exclusive.

    The text is split at the matches: the lengths of what lies between and of the matches, summed up, are the places.
    Rows that repeat a blob give equal pieces, which count once.
    """
    def lengths(r: SecretRule) -> Column:
        wanted = F.array_contains("todo", r.key) & (F.col("text").contains(r.hint) if r.hint else F.lit(True)) & F.col("text").rlike(r.pattern)
        size = lambda xs: F.transform(xs, lambda x: F.length(x))
        zipped = F.arrays_zip(size(F.split("text", r.pattern, -1)).alias("gap"), size(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).alias("match"), size(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group))).alias("checked"))
        shaped = F.transform(zipped, lambda z, i: F.struct(F.lit(r.key).alias("rule"), i.alias("i"), z["gap"].alias("gap"), z["match"].alias("match"), (z["checked"] >= r.least).alias("ok")))
        return F.when(wanted, shaped)

    none = F.array().cast("array<struct<rule:string,i:int,gap:int,match:int,ok:boolean>>")
    pieces = texts.select("blob", F.inline(F.concat(*(F.coalesce(lengths(r), none) for r in rules)))).distinct()
    so_far = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = pieces.withColumn("end", F.sum(F.col("gap") + F.coalesce("match", F.lit(0))).over(so_far).cast("int"))
    return ends.where("ok").select("blob", "rule", (F.col("end") - F.col("match")).alias("start"), "end")


def scan_unseen(docs: DataFrame, ledger: Ledger, rules: tuple[SecretRule, ...] = RULES, path: str = "path", text: str = "text") -> DataFrame:
    """Brings the ledger up to date with the texts; returns (path, blob) of every row."""
    versions = save(docs.select(F.col(path).alias("path"), blob(text).alias("blob")), "secret-versions")
    seen = ledger.scanned().groupBy("blob").agg(F.collect_set("rule").alias("seen"))  # as many as there are rules
    keys = F.array(*(F.lit(r.key) for r in rules))
    one = versions.groupBy("blob").agg(F.min("path").alias("one"))
    todo = one.join(seen.hint("merge"), "blob", "left").withColumn("todo", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>"))))
    todo = save(todo.where(F.size("todo") > 0).select("blob", "one", "todo"), "secret-todo")
    texts = docs.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"), blob(text).alias("own"))
    texts = texts.join(todo.hint("shuffle_hash"), (texts.own == todo.blob) & texts.path.eqNullSafe(todo.one))
    found = spans(texts.select("blob", "text", "todo"), rules)
    ledger.append(found, todo.select("blob", F.explode("todo").alias("rule")))
    return versions


def summary(ledger: Ledger, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """A row for each blob with findings of these rules: found, sorted by start, then kind as listed."""
    known = F.create_map(*(x for n, r in enumerate(rules) for x in (F.lit(r.key), F.struct(F.lit(n).alias("no"), F.lit(r.kind).alias("kind")))))
    rows = ledger.found().where(F.col("rule").isin([r.key for r in rules])).distinct().withColumn("known", F.element_at(known, F.col("rule")))
    return rows.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", F.col("known.no").alias("no"), F.col("known.kind").alias("kind"), "end"))).alias("found"))


def small_findings(found: DataFrame, column: str = "found") -> DataFrame:
    """Hint a summary as a join side: broadcast if both its blobs and all their spans are few, else a sort-merge join."""
    sizes = found.agg(F.count(F.lit(1)).alias("blobs"), F.coalesce(F.sum(F.size(column)), F.lit(0)).alias("spans")).first()
    return F.broadcast(found) if sizes["blobs"] <= MANY_BLOBS and sizes["spans"] <= MANY_SPANS else found.hint("merge")


def join_back(versions: DataFrame, ledger: Ledger, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """All rows of versions with the found spans of their blob (an empty array if none)."""
    found = save(summary(ledger, rules), "secret-found")
    out = versions.join(small_findings(found), "blob", "left")
    return out.withColumn("found", F.coalesce("found", F.array().cast(found.schema["found"].dataType)))


def scan(docs: DataFrame, ledger: Ledger, rules: tuple[SecretRule, ...] = RULES, path: str = "path", text: str = "text") -> DataFrame:
    """(path, blob, found) of every row; found holds structs of start, no, kind, end."""
    return join_back(scan_unseen(docs, ledger, rules, path, text), ledger, rules)


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with every found span replaced by the mark; spans that overlap become one."""
    step = lambda a, s: F.when(s["end"] <= a["at"], a).when(
        s["start"] < a["at"], F.struct(a["out"].alias("out"), s["end"].alias("at"))
    ).otherwise(F.struct(F.concat(a["out"], text.substr(a["at"] + 1, s["start"] - a["at"]), F.lit(mark)).alias("out"), s["end"].alias("at")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(found, start, step, lambda a: F.concat(a["out"], text.substr(a["at"] + 1, F.length(text)))))
