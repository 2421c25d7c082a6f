"""Quarterly filing extracts: headers (sub.txt) and numbers (num.txt), tab separated."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quarterdeck import schemas
from quarterdeck.config import INGEST, RECONCILE
from quarterdeck.functions.scalars import col, finite
from quarterdeck.tags import TRACKED_TAGS

SUB_COLUMNS = ["adsh", "cik", "form", "filed"]
NUM_COLUMNS = ["adsh", "tag", "ddate", "qtrs", "uom", "value", "coreg", "segments"]
UNITS = ["USD", "shares", "pure"]


def require_columns(df: DataFrame, file: str, wanted: list[str]) -> DataFrame:
    """S3: a missing column is an error, an empty cell is data."""
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"{file}: missing columns {missing}, header is {df.columns}")
    return df


def compact_date(text) -> Column:
    t = col(text)
    return F.when(t.rlike(r"^\d{8}$"), F.try_to_timestamp(t, F.lit("yyyyMMdd")).cast("date"))


def _text(c) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def parse_sub(raw: DataFrame) -> DataFrame:
    """Usable filing headers out of all-text rows."""
    require_columns(raw, "sub.txt", SUB_COLUMNS)
    return (raw.select("adsh", F.col("cik").try_cast("double").try_cast("long").alias("cik"), _text("form").alias("form"),
                       compact_date("filed").alias("filed"))
            .where("adsh <> '' AND cik IS NOT NULL AND filed IS NOT NULL"))


def parse_num(raw: DataFrame) -> DataFrame:
    """Numeric rows out of all-text rows; rows without a finite value or period length are dropped."""
    require_columns(raw, "num.txt", NUM_COLUMNS)
    parsed = raw.select(*[_text(c).alias(c) for c in ("adsh", "tag", "ddate", "uom", "coreg", "segments")],
                        F.col("qtrs").try_cast("double").alias("qtrs"), F.col("value").try_cast("double").alias("value"))
    return parsed.where(finite("value") & finite("qtrs")).withColumn("qtrs", F.col("qtrs").try_cast("int")).where("qtrs IS NOT NULL")


def extract_facts(num: DataFrame, sub: DataFrame, universe: DataFrame) -> DataFrame:
    """Consolidated facts of tracked tags filed by universe companies. Filters run before the join on the filing."""
    filings = sub.join(universe.select("cik"), "cik", "left_semi")
    wanted = num.where("coreg = '' AND segments = ''").where(F.col("tag").isin(TRACKED_TAGS) & F.col("uom").isin(UNITS))
    return (wanted.withColumn("period_end", compact_date("ddate")).where("period_end IS NOT NULL")
            .join(filings, "adsh")
            .select("cik", "tag", F.col("uom").alias("unit"), F.lit(None).cast("date").alias("period_start"), "period_end",
                    "qtrs", "value", "form", F.col("filed").alias("filed_date"), F.col("adsh").alias("accession"),
                    F.lit("bulk").alias("source")))


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def read_tsv(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """All-text rows with the wanted columns, the file they come from, and whether the line has another number of cells than the header."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    names = require_columns(spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False), path, wanted).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, "_corrupt_record"]])
    rows = spark.read.option("columnPruning", False).csv(path, sep="\t", header=True, quote="", schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", enforceSchema=False)
    return rows.select(*names, F.col("_metadata.file_path").alias("_file"), F.col("_corrupt_record").isNotNull().alias("_broken"))


def read_sub(spark: SparkSession, path: str) -> DataFrame:
    return parse_sub(read_tsv(spark, path, SUB_COLUMNS).where("NOT _broken"))


def read_num(spark: SparkSession, path: str) -> DataFrame:
    return parse_num(read_tsv(spark, path, NUM_COLUMNS).where("NOT _broken"))


def derive_qtrs(start, end) -> Column:
    """Length of a period in quarters, 0 for an instant."""
    days = F.datediff(col(end), col(start))
    return (F.when(col(start).isNull() | (days <= 0), 0)
            .otherwise(F.greatest(F.lit(1), F.round(days / F.lit(RECONCILE["quarter_days"])).cast("int"))))


def recent_quarters(as_of, n: int = INGEST["bulk_quarters"]) -> Column:
    """First days of the n newest quarters whose extract is published, newest first."""
    if n <= 0:
        return F.array().cast("array<date>")
    newest = F.date_trunc("quarter", F.date_sub(col(as_of), INGEST["publication_lag_days"])).cast("date")
    return F.sequence(newest, F.add_months(newest, F.lit(-3 * (n - 1))), F.expr("INTERVAL -3 MONTH"))


REPORT = "quarter string, status string, lines long, broken_lines long, facts long, error string"


def quarter_label(q) -> str:
    return f"{q.year}q{(q.month + 2) // 3}"


def load_bulk(spark: SparkSession, root: str, quarters: list, universe: DataFrame, layout: str = "{root}/{quarter}/{file}") -> tuple[DataFrame, DataFrame]:
    """(facts of the quarter folders that can be read, report). The report has a row per quarter asked for: loaded with its numbers of lines,
    lines left out for their number of cells, and facts; or failed with the error. A quarter fails if a file of it is missing, lacks a column, has no
    usable line or can't be read to its end; each is read through once as a check, so damage shows here and not in a later action."""
    loaded, report = None, []
    for label in map(quarter_label, quarters):
        num_path, sub_path = [layout.format(root=root, quarter=label, file=f) for f in ("num.txt", "sub.txt")]
        try:
            num = read_tsv(spark, num_path, NUM_COLUMNS)
            facts = extract_facts(parse_num(num.where("NOT _broken")), read_sub(spark, sub_path), universe)
            lines = num.groupBy("_file").agg(F.count(F.lit(1)).alias("lines"), F.count_if("_broken").alias("broken"), F.count_if(~F.col("_broken") & (F.col("adsh") != "")).alias("usable")).agg(
                *[F.sum(c).alias(c) for c in ("lines", "broken", "usable")], F.max_by("_file", "broken").alias("worst")).first()
            if not lines["usable"]:
                raise ValueError(f"no usable line in {lines['worst'] or label}")
            report.append((label, "loaded", lines["lines"], lines["broken"], facts.count(), None))
        except Exception as e:  # any error of one quarter is that quarter's outcome
            report.append((label, "failed", None, None, None, f"{type(e).__name__}: {next(iter(str(e).splitlines()), '')}"[:500]))
            continue
        loaded = facts if loaded is None else loaded.unionByName(facts)
    if loaded is None:
        loaded = spark.createDataFrame([], T.StructType([f for f in schemas.FACT if f.name != "load_seq"]))
    return loaded, spark.createDataFrame(report, REPORT)
