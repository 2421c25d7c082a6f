"""Which companies must be fetched again."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarterdeck.config import INGEST
from quarterdeck.tags import TRACKED_TAGS


def universe(companies: DataFrame, classification: DataFrame) -> DataFrame:
    """active companies that carry a classification."""
    return companies.where("is_active").join(classification.select("cik"), "cik", "left_semi")


def coverage(facts: DataFrame) -> DataFrame:
    """A10: newest filing and number of api facts per company, in one pass over the log."""
    api = F.col("source") == "api"
    return facts.groupBy("cik").agg(
        F.max("filed_date").alias("latest"), F.max(F.when(api, F.col("filed_date"))).alias("api_latest"),
        F.count_if(api).alias("api_facts"))


def fingerprint(tags: list[str] = TRACKED_TAGS):
    """Identity of a tag set, the same for any order of its members."""
    listed = F.array_sort(F.array_distinct(F.array(*[F.lit(t) for t in tags])))
    return F.substring(F.sha2(F.concat_ws("\n", listed), 256), 1, 16)


def fingerprint_of(df: DataFrame, tag: str = "tag", tags: list[str] = TRACKED_TAGS) -> DataFrame:
    """K18 over the tracked tags found in a table. Every task sends each tag once at most, so the last one gathers a short list of names."""
    return df.where(F.col(tag).isin(tags)).select(tag).distinct().agg(F.substring(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_set(tag))), 256), 1, 16).alias("fingerprint"))


def stale(members: DataFrame, cover: DataFrame, as_of: str, column: str = "latest") -> DataFrame:
    """K13 and, with ``api_latest``, K14."""
    cutoff = F.date_sub(F.lit(as_of).cast("date"), INGEST["stale_days"])
    return members.join(cover, "cik", "left").where(F.col(column).isNull() | (F.col(column) < cutoff)).select("cik")


def thin(members: DataFrame, cover: DataFrame, min_facts: int = INGEST["thin_coverage_min_facts"]) -> DataFrame:
    """Too few api facts; companies without any fact belong to the stale net instead."""
    return members.join(cover, "cik").where(F.col("api_facts") < min_facts).select("cik")


def tag_set_changed(members: DataFrame, state: DataFrame, current) -> DataFrame:
    """Never fetched, or fetched for another tag set."""
    return (members.join(state.select("cik", "tags_fingerprint"), "cik", "left")
            .where(~F.col("tags_fingerprint").eqNullSafe(current)).select("cik"))


def refetch_plan(members, cover, state, as_of: str, current, min_facts=INGEST["thin_coverage_min_facts"]) -> DataFrame:
    """Every company to fetch once, with the nets that caught it."""
    cutoff = F.date_sub(F.lit(as_of).cast("date"), INGEST["stale_days"])
    joined = (members.select("cik").join(cover, "cik", "left")
              .join(state.select("cik", "tags_fingerprint"), "cik", "left"))
    nets = F.array_compact(F.array(
        F.when(F.col("latest").isNull() | (F.col("latest") < cutoff), "stale"),
        F.when(F.col("api_latest").isNull() | (F.col("api_latest") < cutoff), "api_stale"),
        F.when(F.col("api_facts") < min_facts, "thin"),
        F.when(~F.col("tags_fingerprint").eqNullSafe(current), "tag_set")))
    return joined.select("cik", nets.alias("nets")).where(F.size("nets") > 0)
