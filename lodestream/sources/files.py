"""Market and factor files: pipe-separated files with trailers, company facts, series in JSON and CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

DECIMAL = "decimal(38,10)"
FACTS = "cik long, facts map<string,map<string,struct<units:map<string,array<struct<start:string,end:string,val:string,accn:string,fy:int,fp:string,form:string,filed:string>>>>>>"


def canonical(header: str) -> str:
    return "_".join("".join(c if c.isalnum() else " " for c in header.lower()).split())


def pipe_rows(lines: DataFrame, header: list[str], order: str = "line") -> tuple[DataFrame, DataFrame]:
    """Rows and rejected lines of a pipe file (columns ``value`` and ``line``, its number).

    The header line and a trailer (fewer fields than the header) are no rows; a line
    with more or fewer fields that isn't the last is rejected.
    """
    cut = lines.withColumn("f", F.split("value", r"\|"))
    width = len(header)
    is_header = F.lower(F.trim(F.col("f")[0])) == header[0].lower()
    last = lines.agg(F.max(order).alias("_last"))
    body = cut.filter(~is_header & (F.trim("value") != "")).crossJoin(F.broadcast(last))  # one row
    ok = F.size("f") == width
    rows = body.filter(ok).select(order, *[F.trim(F.col("f")[i]).alias(canonical(h)) for i, h in enumerate(header)])
    return rows, body.filter(~ok & (F.col(order) != F.col("_last"))).select(order, "value")


def trailer_count(lines: DataFrame, order: str = "line") -> DataFrame:
    """The number in the last line, if it is a trailer."""
    return lines.orderBy(F.desc(order)).limit(1).select(F.regexp_extract("value", r"(\d+)\s*$", 1).try_cast("long").alias("expected"))


def short_volume(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows, bad = pipe_rows(lines, ["Date", "Symbol", "ShortVolume", "ShortExemptVolume", "TotalVolume", "Market"])
    number = lambda c: F.col(c).try_cast(DECIMAL)
    total = number("totalvolume")
    return rows.select("line", F.try_to_date("date", "yyyyMMdd").alias("trade_date"), "symbol", number("shortvolume").alias("short_volume"), total.alias("total_volume"), F.when(total > 0, number("shortvolume") / total).alias("short_ratio"), "market"), bad


def fails_to_deliver(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows, bad = pipe_rows(lines, ["SETTLEMENT DATE", "CUSIP", "SYMBOL", "QUANTITY (FAILS)", "DESCRIPTION", "PRICE"])
    price, quantity = F.when(F.col("price") != ".", F.col("price")).try_cast(DECIMAL), F.col("quantity_fails").try_cast("long")
    return rows.select("line", F.try_to_date("settlement_date", "yyyyMMdd").alias("settlement_date"), "cusip", "symbol", quantity.alias("quantity"), price.alias("price"), (price * quantity).alias("notional")), bad


def symbol_directory(listed: DataFrame, other: DataFrame) -> DataFrame:
    """Unified records of both symbol files; test issues are inactive."""
    a, _ = pipe_rows(listed, ["Symbol", "Security Name", "Market Category", "Test Issue", "Financial Status", "Round Lot Size", "ETF", "NextShares"])
    b, _ = pipe_rows(other, ["ACT Symbol", "Security Name", "Exchange", "CQS Symbol", "ETF", "Round Lot Size", "Test Issue", "NASDAQ Symbol"])
    venue = T.lookup(F.col("exchange"), {"A": "NYSE American", "N": "NYSE", "P": "NYSE Arca", "Z": "Cboe BZX", "V": "IEX"}, "unknown")
    one = a.select(F.col("symbol").alias("ticker"), F.lit("NASDAQ").alias("exchange"), F.col("security_name").alias("name"), (F.col("etf") == "Y").alias("is_etf"), (F.col("test_issue") != "Y").alias("is_active"))
    two = b.select(F.col("act_symbol").alias("ticker"), venue.alias("exchange"), F.col("security_name").alias("name"), (F.col("etf") == "Y").alias("is_etf"), (F.col("test_issue") != "Y").alias("is_active"))
    return one.unionByName(two)


def company_facts(lines: DataFrame) -> DataFrame:
    """Flat observations of nested fact documents (a column ``value``); entries without a value, end or filing date are skipped."""
    p = lines.select(F.from_json("value", FACTS).alias("p"))
    rows = p.select("p.cik", F.explode("p.facts").alias("taxonomy", "t")).select("cik", "taxonomy", F.explode("t").alias("fact", "f")).select("cik", "taxonomy", "fact", F.explode("f.units").alias("unit", "u")).select("cik", "taxonomy", "fact", "unit", F.explode("u").alias("o"))
    out = rows.select("cik", "taxonomy", "fact", "unit", F.try_to_date("o.start", "yyyy-MM-dd").alias("period_start"), F.try_to_date("o.end", "yyyy-MM-dd").alias("period_end"), F.col("o.val").try_cast(DECIMAL).alias("value"), F.col("o.accn").alias("accession"), F.col("o.form").alias("form"), F.try_to_date("o.filed", "yyyy-MM-dd").alias("filed"))
    return out.filter("value is not null and period_end is not null and filed is not null")


def series_json(lines: DataFrame, factor_id: Column) -> DataFrame:
    """Observations of {"observations":[{"date","value"}]} documents; missing marks give null."""
    p = lines.select(factor_id.alias("factor_id"), F.explode(F.from_json("value", "observations array<struct<date:string,value:string>>")["observations"]).alias("o"))
    value = T.number(F.col("o.value"))
    return p.select("factor_id", F.try_to_date("o.date", "yyyy-MM-dd").alias("observation_date"), value.alias("value"), F.when(value.isNull(), "missing").alias("missing_reason")).filter("observation_date is not null")


def period_date(year: Column, period: Column) -> Column:
    """First day of M01-M12 or Q1-Q4 (Q01-Q04); M13, an annual mean, is null."""
    m = F.regexp_extract(period, r"^M(\d\d)$", 1).try_cast("int")
    q = F.regexp_extract(period, r"^Q0?([1-4])$", 1).try_cast("int")
    return F.when(m.between(1, 12), F.make_date(year, m, F.lit(1))).when(q.isNotNull(), F.make_date(year, q * 3 - 2, F.lit(1)))


def array_table(lines: DataFrame) -> DataFrame:
    """(row, column, cell) of an array of arrays whose first row is the header."""
    a = lines.select(F.from_json("value", "array<array<string>>").alias("a"))
    body = a.select(F.col("a")[0].alias("h"), F.posexplode("a").alias("row", "cells")).filter("row > 0")
    return body.select("row", F.posexplode("cells").alias("i", "cell"), "h").select("row", F.get("h", F.col("i")).alias("column"), "cell")


def csv_after_header(lines: DataFrame, starts: tuple[str, ...] = ("Time Period,", "Date,")) -> DataFrame:
    """(line, date, value) of the rows behind the header line, which one of starts begins; without a header no rows."""
    head = F.col("value").startswith(starts[0]) | F.col("value").startswith(starts[1])
    at = lines.filter(head).agg(F.min("line").alias("_h"))
    f = F.split("value", ",")
    return lines.crossJoin(F.broadcast(at)).filter("line > _h").select("line", F.trim(f[0]).alias("date"), T.number(F.get(f, F.lit(1))).alias("value"))  # one row
