"""Files in and out: delimited text, trees of files, binary corpora, exports, manifests."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.shared import saved

DELIMITERS = [",", ";", "\t", "|"]


def votes(lines: Column) -> Column:
    """The delimiter met most often in the lines, as an aggregate; the first of several."""
    counts = F.array(*(F.struct(F.coalesce(F.sum(F.size(F.split(lines, re.escape(d))) - 1), F.lit(0)).alias("met"), F.lit(-n).alias("order"), F.lit(d).alias("sep")) for n, d in enumerate(DELIMITERS)))
    return F.array_max(counts)["sep"]


def delimiter(spark: SparkSession, path: str, lines: int = 20) -> str:
    """The delimiter met most often in the first lines."""
    return spark.read.text(path).limit(lines).agg(votes(F.col("value"))).first()[0]


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-8 if every line is that, else Latin-1, in which any byte is a letter."""
    return "ISO-8859-1" if spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count() else "UTF-8"


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, sep: str | None = None) -> DataFrame:
    """A delimited file with a header, its encoding and delimiter found unless given; lines that don't fit are left out."""
    return spark.read.csv(path, sep=sep or delimiter(spark, path), header=True, encoding=encoding or encoding_of(spark, path), mode="DROPMALFORMED")


def quality(df: DataFrame) -> DataFrame:
    """Share of cells that aren't null: one row."""
    return df.agg((sum((F.count(c) for c in df.columns), F.lit(0)) / F.nullif(F.count(F.lit(1)) * len(df.columns), F.lit(0))).alias("quality"), F.count(F.lit(1)).alias("rows"))


def plain_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"[\s-]+", "_")


def csv_tree(spark: SparkSession, root: str, country: str, name: str = r"(?i).*(summary|exposure|counts|adm1|national).*\.csv$") -> DataFrame:
    """All CSV files whose name fits the pattern and of whose folders one bears the country's name (holds it, or lies in it), with their path. Each file is read with its own delimiter; columns that only some have are null in the others."""
    norm = plain_name(F.lit(country))
    lines = spark.read.option("recursiveFileLookup", True).text(root).select("value", F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"))
    inside = F.substring_index("path", root.rpartition("/")[2] + "/", -1)
    folders = F.transform(F.slice(F.split(inside, "/"), 1, F.size(F.split(inside, "/")) - 1), lambda d: plain_name(F.regexp_replace(d, "^[A-Za-z_]+=", "")))
    fits = F.exists(folders, lambda d: (d != "") & (d.contains(norm) | norm.contains(d))) & F.substring_index("path", "/", -1).rlike(name)
    files = lines.where(fits).groupBy("path").agg(votes(F.col("value")).alias("sep"))
    found = files.groupBy("sep").agg(F.array_sort(F.collect_list("path")).alias("paths")).orderBy("sep").collect()  # names of files, which Spark lists on the driver too
    parts = [spark.read.csv(r["paths"], sep=r["sep"], header=True, mode="DROPMALFORMED").withColumn("path", F.col("_metadata.file_path")) for r in found]
    if not parts:
        return spark.createDataFrame([], "path string")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


# Extensions, kind, most bytes, leading bytes in hex.
KINDS = [
    (["pdf"], "pdf", 50 * 1024 * 1024, "25504446"), (["msg"], "email", 25 * 1024 * 1024, "D0CF11E0"), (["eml"], "email", 25 * 1024 * 1024, ""), (["xlsx", "xlsm"], "excel", 10 * 1024 * 1024, "504B0304"), (["xls"], "excel", 10 * 1024 * 1024, "D0CF11E0"),
    (["docx"], "word", 15 * 1024 * 1024, "504B0304"), (["doc"], "word", 15 * 1024 * 1024, "D0CF11E0"), (["pptx"], "powerpoint", 20 * 1024 * 1024, "504B0304"), (["ppt"], "powerpoint", 20 * 1024 * 1024, "D0CF11E0"), (["csv"], "csv", 5 * 1024 * 1024, ""),
    (["png"], "image", 10 * 1024 * 1024, "89504E47"), (["jpg", "jpeg"], "image", 10 * 1024 * 1024, "FFD8FF"), (["tiff", "tif"], "image", 10 * 1024 * 1024, ""), (["bmp"], "image", 10 * 1024 * 1024, "424D"),
]


SUSPICIOUS = ["<script", "javascript:", "vbscript:", "data:text/html"]
#: No file of more bytes is safe, whatever its kind.
SECURITY_BYTES = 500 * 1024 * 1024


def scanned(files: DataFrame, kinds: list = KINDS, security_bytes: int = SECURITY_BYTES) -> DataFrame:
    """files: path, length, content (as the binaryFile source gives them; null: not read). Kind, digest and errors of each file."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    one = lambda n: F.element_at(F.create_map(*(F.lit(x) for k in kinds for e in k[0] for x in (e, k[n]))), ext)
    head, text = F.hex(F.substring("content", 1, 8)), F.lower(F.decode("content", "ISO-8859-1"))
    pattern = F.coalesce(*(F.when(text.contains(p), F.lit(f"suspicious pattern {p}")) for p in SUSPICIOUS))
    errors = F.array_compact(
        F.array(
            F.when(one(1).isNull(), "type not allowed"), F.when(F.col("length") > one(2), "file too large"), F.when(F.col("length") == 0, "file is empty"), F.when(~head.startswith(F.coalesce(one(3), F.lit(""))), "content does not fit the extension"),
            F.when(F.hex(F.substring("content", 1, 2)) == "4D5A", "executable content"), pattern, F.when(F.col("length") > security_bytes, "beyond the security limit"),
        )
    )
    return files.select("path", ext.alias("extension"), one(1).alias("kind"), "length", F.sha2("content", 256).alias("digest"), errors.alias("errors"))


def corpus(spark: SparkSession, root: str, name: Callable[[Column], Column] | None = None, kinds: list = KINDS, security_bytes: int = SECURITY_BYTES) -> DataFrame:
    """All files below a folder as scanned; name(path) tells a file's name, if its path doesn't. Files longer than any kind may be are listed, but not read: the source drops them by their length before it opens them, and they have no digest. Files without bytes are not there: Spark's file sources leave them out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    named = files.withColumn("path", name(F.col("path"))) if name else files
    most = max(k[2] for k in kinds)
    read = named.where(F.col("length") <= most).select("path", "length", "content")
    listed = named.where(F.col("length") > most).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return scanned(read, kinds, security_bytes).unionByName(scanned(listed, kinds, security_bytes))


def unseen(items: DataFrame, manifest: DataFrame, text: str = "text") -> DataFrame:
    """Items whose content is not in the manifest (digest) yet."""
    return items.withColumn("digest", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).join(manifest.select("digest").distinct().hint("merge"), "digest", "left_anti")


class Manifest:
    """Digests of contents that were processed, over any number of runs. A run counts once its digests are written whole, which comes last; what an aborted run left is replaced by the next one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def runs(self) -> int:
        """Runs that were completed."""
        jvm = self.spark._jvm
        done = lambda n: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/run={n}/_SUCCESS")
        fs = done(0).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        n = 0
        while fs.exists(done(n)):
            n += 1
        return n

    def digests(self) -> DataFrame:
        done = [f"{self.folder}/run={n}" for n in range(self.runs())]
        return self.spark.read.schema("digest string").parquet(*done) if done else self.spark.createDataFrame([], "digest string")

    def process(self, items: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, text: str = "text") -> int:
        """Writes work(the items whose content is new) below out, and then their digests; the number of this run. Items of equal new content are all new."""
        n = self.runs()
        fresh = saved(unseen(items, self.digests(), text), "manifest-fresh")
        work(fresh).write.mode("overwrite").parquet(f"{out}/run={n}")
        fresh.select("digest").distinct().write.mode("overwrite").parquet(f"{self.folder}/run={n}")
        return n


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """Each sheet as a table of its own below the path."""
    for name, df in sheets.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_workbook(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def application_export(apps: DataFrame, params: DataFrame, fin: DataFrame, losses: DataFrame) -> DataFrame:
    """One nested JSON document an application."""
    events = losses.groupBy("application_id").agg(F.array_sort(F.collect_list(F.struct(F.date_format("event_date", "yyyy-MM-dd").alias("date"), F.col("amount").cast("double").alias("amount"), "cause"))).alias("losses"))
    both = apps.select("application_id", "status").join(params, "application_id", "left").join(fin, "application_id", "left").join(events, "application_id", "left")
    return both.select("application_id", F.to_json(F.struct("application_id", "status", F.struct("location", "industry_sector", "occupancy").alias("risk"), F.struct("credit_rating").alias("financial"), "losses")).alias("document"))


def metric_export(points: DataFrame, most: int = 10_000) -> DataFrame:
    """Points grouped by metric and hour, as JSON; an hour of many points is dealt to parts of about `most` points."""
    hour = F.date_trunc("hour", "created_at").alias("hour")
    own = points.select("metric", hour, "created_at", "value")
    parts = own.groupBy("metric", "hour").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"))
    dealt = own.join(parts.hint("merge"), ["metric", "hour"]).withColumn("part", F.pmod(F.xxhash64("created_at", "value"), F.col("parts")).cast("int"))
    by = dealt.groupBy("metric", "hour", "part").agg(F.array_sort(F.collect_list(F.struct("created_at", "value"))).alias("points"))
    return by.select("metric", "hour", "part", F.size("points").alias("n"), F.to_json(F.struct("metric", "points")).alias("document"))


def diagnostics(expected: DataFrame, found: DataFrame, schema: str) -> DataFrame:
    """expected: name. found: name, content. State of each expected result: loaded, missing or invalid."""
    parsed = found.withColumn("parsed", F.from_json("content", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    both = expected.join(parsed, "name", "left")
    return both.select("name", F.when(F.col("content").isNull(), "missing").when(F.col("parsed._corrupt").isNotNull() | F.col("parsed").isNull(), "invalid").otherwise("loaded").alias("state"))


def exposure_totals(df: DataFrame) -> DataFrame:
    """Sums over the columns whose names speak of replacement cost, buildings or area; one row."""
    of = lambda test: [c for c in df.columns if test(c.upper())]
    total = lambda cs: F.coalesce(F.sum(sum((F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0)) for c in cs), F.lit(0.0))), F.lit(0.0))
    return df.agg(total(of(lambda c: "REPL" in c)).alias("replacement_cost"), total(of(lambda c: "BUILD" in c or "COUNT" in c)).alias("buildings"), total(of(lambda c: "AREA" in c or "SQM" in c)).alias("area"))


def exposure_breakdown(files: list[DataFrame], word: str, value: str) -> DataFrame:
    """Sums of a value by the first column whose name holds the word, over all files."""
    parts = []
    for df in files:
        column = next((c for c in df.columns if word in c.upper()), None)
        if column:
            parts.append(df.select(F.col(column).cast("string").alias("category"), F.col(value).cast("string").try_cast("double").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("category").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))
