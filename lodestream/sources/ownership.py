"""Ownership filings: information tables in XML, and schedules in prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HOLDINGS = "infoTable array<struct<nameOfIssuer:string,titleOfClass:string,cusip:string,value:string,shrsOrPrnAmt:struct<sshPrnamt:string,sshPrnamtType:string>>>"
# Patterns of the schedules
CUSIP = r"(?i)CUSIP(?: No\.)?\s*([A-Z0-9]{6,12})"
PERCENT = r"(?is)Percent of Class.*?(\d+(?:\.\d+)?)\s*%"
SHARES = r"(?is)Aggregate Amount Beneficially Owned.*?(\d[\d,]*)"


def decimal(text: Column) -> Column:
    """A number with commas; null if it is none."""
    return F.trim(F.regexp_replace(text, ",", "")).try_cast("decimal(38,4)")


def holdings(filings: DataFrame, xml: str = "content") -> tuple[DataFrame, DataFrame]:
    """(filer, filed, cusip, issuer, title, shares, value; filings without a table) of 13F information tables; XML prefixes are dropped."""
    plain = F.regexp_replace(F.col(xml), r"<(/?)[A-Za-z0-9_]+:", "<$1")
    rows = filings.withColumn("_x", F.from_xml(plain, HOLDINGS, {"mode": "PERMISSIVE"}))
    some = F.size(F.coalesce("_x.infoTable", F.array().cast(HOLDINGS.split(" ", 1)[1]))) > 0
    cells = rows.filter(some).select("filer", "filed", F.explode("_x.infoTable").alias("h"))
    good = cells.select("filer", "filed", F.upper(F.trim("h.cusip")).alias("cusip"), F.trim("h.nameOfIssuer").alias("issuer"), F.trim("h.titleOfClass").alias("title"), decimal(F.col("h.shrsOrPrnAmt.sshPrnamt")).alias("shares"), decimal(F.col("h.value")).alias("value"))
    return good, rows.filter(~some).drop("_x")


def schedules(filings: DataFrame, text: str = "content") -> DataFrame:
    """cusip, percent, shares and event_type of schedules 13D and 13G; what isn't found is null."""
    c = F.col(text)
    kind = F.when(F.upper("form").startswith("SC 13G"), "schedule_13g_ownership").otherwise("schedule_13d_ownership")
    return filings.select("*", kind.alias("event_type"), F.upper(F.nullif(F.regexp_extract(c, CUSIP, 1), F.lit(""))).alias("cusip"), decimal(F.regexp_extract(c, PERCENT, 1)).alias("percent"), decimal(F.regexp_extract(c, SHARES, 1)).alias("position_shares"))
