"""Provider payloads: one JSON or XML text a row becomes typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from .ownership import decimal

# The shapes of the payloads
BEA = "BEAAPI struct<Results:struct<Data:array<struct<TimePeriod:string,DataValue:string,CL_UNIT:string,LineDescription:string>>>,Error:string>"
EIA = "response struct<data:array<map<string,string>>>, error string"
WORKS = "results array<struct<id:string,display_name:string,abstract:string,publication_date:string,doi:string,authorships:array<struct<author:struct<display_name:string>,institutions:array<struct<display_name:string,id:string>>>>,topics:array<struct<display_name:string>>,concepts:array<struct<display_name:string>>,primary_location:struct<landing_page_url:string>>>"
ENTRIES = "entry array<struct<id:string,title:string,summary:string,published:string,doi:string,author:array<struct<name:string>>,category:array<struct<_term:string>>,link:array<struct<_rel:string,_href:string>>>>"
FORM4 = "issuer struct<issuerCik:string,issuerName:string,issuerTradingSymbol:string>, reportingOwner struct<reportingOwnerId:struct<rptOwnerCik:string,rptOwnerName:string>>, nonDerivativeTable struct<nonDerivativeTransaction:array<{0}>>, derivativeTable struct<derivativeTransaction:array<{0}>>".format(
    "struct<securityTitle:struct<value:string>,transactionDate:struct<value:string>,transactionCoding:struct<transactionCode:string>,transactionAmounts:struct<transactionShares:struct<value:string>,transactionPricePerShare:struct<value:string>,transactionAcquiredDisposedCode:struct<value:string>>,postTransactionAmounts:struct<sharesOwnedFollowingTransaction:struct<value:string>>,underlyingSecurity:struct<underlyingSecurityShares:struct<value:string>>>"
)
SEED = "concepts array<struct<concept_id:string,name:string,type:string,aliases:array<string>>>, relations array<struct<source:string,target:string,predicate:string>>"
GOLDEN = "documents array<struct<doc_id:string,content:string,expected_claims:array<struct<subject:string,predicate:string,object:string>>>>"


def _spread(c: Column) -> Column:
    return T.normalized(F.coalesce(c, F.lit("")))


def _observed(value: Column) -> list[Column]:
    return [T.number(value).alias("value"), F.when(T.number(value).isNull(), "missing").alias("missing_reason")]


def quarterly_accounts(lines: DataFrame) -> DataFrame:
    """(period, observation_date, value, missing_reason, unit) of national accounts; quarters and months are dated by their first day, years by theirs."""
    o = lines.select(F.explode(F.from_json("value", BEA)["BEAAPI"]["Results"]["Data"]).alias("o")).select("o.*")
    year = F.regexp_extract("TimePeriod", r"^(\d{4})", 1).try_cast("int")
    quarter, month = (F.regexp_extract("TimePeriod", rf"^\d{{4}}{x}", 1).try_cast("int") for x in (r"Q([1-4])$", r"M(\d\d)$"))
    day = F.make_date(year, F.coalesce(quarter * 3 - 2, month, F.lit(1)), F.lit(1))
    return o.select(F.col("TimePeriod").alias("period"), day.alias("observation_date"), *_observed(F.col("DataValue")), F.col("CL_UNIT").alias("unit"))


def fiscal_rows(lines: DataFrame, value_field: str, date_field: str = "record_date") -> DataFrame:
    """Observations of {"data": [{date, value}]} documents by the fields' names."""
    o = lines.select(F.explode(F.from_json("value", "data array<map<string,string>>")["data"]).alias("o"))
    return o.select(F.try_to_date(F.col("o")[date_field], "yyyy-MM-dd").alias("observation_date"), *_observed(F.col("o")[value_field]))


def energy_series(lines: DataFrame, value_field: str = "value") -> DataFrame:
    """Observations of energy series; a month counts from its first day; an error document raises."""
    p = lines.select(F.from_json("value", EIA).alias("p"))
    rows = F.when(F.col("p.error").isNull(), F.col("p.response.data")).otherwise(F.raise_error(F.concat(F.lit("provider error: "), F.col("p.error"))).cast("array<map<string,string>>"))
    o = p.select(F.explode(rows).alias("o"))
    period = F.col("o")["period"]
    day = F.try_to_date(F.when(F.length(period) == 7, F.concat(period, F.lit("-01"))).otherwise(period), "yyyy-MM-dd")
    return o.select(day.alias("observation_date"), *_observed(F.col("o")[value_field]), F.col("o")[f"{value_field}-units"].alias("units"), F.coalesce(F.col("o")["last_updated"], F.col("o")["updated"], period).alias("revision"))


def works(lines: DataFrame) -> DataFrame:
    """Research records of a works API: authors, institutions and topics each once, in their order."""
    w = lines.select(F.explode(F.from_json("value", WORKS)["results"]).alias("w")).select("w.*")
    some = lambda c: F.array_distinct(F.filter(c, lambda x: F.coalesce(x, F.lit("")) != ""))
    none = F.expr("cast(array() as array<string>)")
    names = lambda c: F.coalesce(F.transform(c, lambda x: x["display_name"]), none)
    authors = F.coalesce(F.transform("authorships", lambda a: a["author"]["display_name"]), none)
    institutions = F.coalesce(F.flatten(F.transform("authorships", lambda a: names(a["institutions"]))), none)
    doi = F.nullif(F.regexp_replace(F.lower(F.trim("doi")), r"^https?://(dx\.)?doi\.org/", ""), F.lit(""))
    return w.select(
        F.lit("openalex").alias("source"), F.coalesce("id", F.lit("")).alias("record_id"), F.coalesce("display_name", F.lit("")).alias("title"), F.coalesce("abstract", F.lit("")).alias("abstract"), some(authors).alias("authors"),
        some(institutions).alias("institutions"), some(F.concat(names("topics"), names("concepts"))).alias("topics"), F.try_to_date("publication_date", "yyyy-MM-dd").alias("published"), doi.alias("doi"),
        F.coalesce(F.nullif(F.col("primary_location.landing_page_url"), F.lit("")), "id", F.lit("")).alias("url"),
    )


def preprints(feeds: DataFrame) -> DataFrame:
    """Research records of Atom feeds (a column ``value``); XML prefixes are dropped."""
    plain = F.regexp_replace("value", r"<(/?)[A-Za-z0-9_]+:", "<$1")
    e = feeds.select(F.explode(F.from_xml(plain, ENTRIES, {"attributePrefix": "_"})["entry"]).alias("e")).select("e.*")
    key = F.element_at(F.split(F.regexp_replace(F.coalesce("id", F.lit("")), "/+$", ""), "/"), -1)
    own = F.try_element_at(F.filter("link", lambda x: x["_rel"] == "alternate"), F.lit(1))["_href"]
    return e.select(
        F.lit("arxiv").alias("source"), key.alias("record_id"), _spread(F.col("title")).alias("title"), _spread(F.col("summary")).alias("abstract"), F.transform("author", lambda a: _spread(a["name"])).alias("authors"),
        F.filter(F.transform("category", lambda c: c["_term"]), lambda t: F.coalesce(t, F.lit("")) != "").alias("categories"), F.to_date(F.try_to_timestamp("published")).alias("published"), F.nullif(_spread(F.col("doi")), F.lit("")).alias("doi"), F.coalesce(own, "id").alias("url"),
    )


def bulk_patents(rows: DataFrame, snapshot: Column, fetched: Column, most_days: int = 120, allow_stale: bool = False) -> DataFrame:
    """Patent records of bulk rows, whose columns have several spellings; a snapshot older than most_days raises, or is marked where that is allowed."""
    first = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in rows.columns], F.lit(""))
    listed = lambda *names: F.filter(F.transform(F.split(first(*names), "[;|]"), lambda x: F.trim(x)), lambda x: x != "")
    age = F.datediff(fetched, snapshot)
    fault = F.concat(F.lit("bulk snapshot is stale: "), age.cast("string"), F.lit(" days old"))
    stale = F.when((age > most_days) & F.lit(not allow_stale), F.raise_error(fault).cast("boolean")).otherwise(age > most_days)
    patent, application = first("patent_number", "patent_id", "patentNumber"), first("application_number", "application_id")
    family = F.coalesce(F.nullif(first("family_id", "familyId"), F.lit("")), F.nullif(application, F.lit("")), patent)
    day = lambda *names: F.try_to_date(first(*names), "yyyy-MM-dd")
    return rows.select(
        patent.alias("patent_id"), application.alias("application_id"), family.alias("family_id"), first("invention_title", "patent_title", "title").alias("title"), listed("assignee_organization", "assignees").alias("assignees"),
        listed("cpc_group_id", "cpc_classes").alias("classes"), day("filing_date", "application_date").alias("application_date"), day("grant_date", "patent_date").alias("grant_date"), age.alias("snapshot_age_days"), stale.alias("snapshot_stale"),
    )


def insider_transactions(filings: DataFrame, xml: str = "content") -> tuple[DataFrame, DataFrame]:
    """(transactions of Form 4 filings, filings without any): both tables, numbered in each.

    filings: accession, cik, ticker and the XML.  An issuer without CIK and symbol in the form
    takes the filing's; mapping_status says what is unresolved.
    """
    rows = filings.withColumn("_x", F.from_xml(F.col(xml), FORM4, {"mode": "PERMISSIVE"}))
    kind = "array<" + FORM4.split("nonDerivativeTransaction:array<", 1)[1].split(">>, derivativeTable", 1)[0] + ">"
    lists = [F.coalesce(F.col(c), F.expr(f"cast(array() as {kind})")) for c in ("_x.nonDerivativeTable.nonDerivativeTransaction", "_x.derivativeTable.derivativeTransaction")]
    none = (F.size(lists[0]) == 0) & (F.size(lists[1]) == 0)
    of = lambda x, name: F.transform(x, lambda t, n: F.struct(n.alias("n"), t.alias("t"), F.lit(name).alias("table")))
    # one reading of both tables; outer, as Spark would derive a filter from the other form and parse every filing once more for it
    t = rows.select("*", F.explode_outer(F.concat(of(lists[0], "non_derivative"), of(lists[1], "derivative"))).alias("_t")).select("*", "_t.*").filter("`table` is not null")
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    cik, symbol, owner = text("_x.issuer.issuerCik"), text("_x.issuer.issuerTradingSymbol"), text("_x.reportingOwner.reportingOwnerId.rptOwnerCik")
    return t.select(
        "accession", "table", "n", F.concat(F.lit("form4_"), F.col("table"), F.lit("_transaction")).alias("event_type"), F.coalesce(cik, F.col("cik").cast("string")).alias("issuer_cik"), F.coalesce(symbol, "ticker").alias("issuer_ticker"), owner.alias("filer_cik"),
        text("_x.reportingOwner.reportingOwnerId.rptOwnerName").alias("filer_name"), text("t.securityTitle.value").alias("security_title"), text("t.transactionCoding.transactionCode").alias("code"), F.try_to_date("t.transactionDate.value", "yyyy-MM-dd").alias("transaction_date"),
        decimal(F.col("t.transactionAmounts.transactionShares.value")).alias("shares"), decimal(F.col("t.transactionAmounts.transactionPricePerShare.value")).alias("price"), text("t.transactionAmounts.transactionAcquiredDisposedCode.value").alias("acquired_disposed"),
        decimal(F.col("t.postTransactionAmounts.sharesOwnedFollowingTransaction.value")).alias("owned_after"), decimal(F.col("t.underlyingSecurity.underlyingSecurityShares.value")).alias("underlying_shares"),
        F.when(F.coalesce(cik, symbol).isNull() | owner.isNull(), "unresolved").otherwise("resolved").alias("mapping_status"),
    ), rows.filter(none).drop("_x")


def seed_objects(packs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(concepts, aliases, relations) of coverage packs in JSON; relations to concepts that no pack has are left out."""
    p = packs.select(F.from_json("value", SEED).alias("p"))
    c = p.select(F.explode("p.concepts").alias("c")).select("c.*")
    concepts = c.select("concept_id", "name", "type").dropDuplicates(["concept_id"])
    aliases = c.select("concept_id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.expr("cast(array() as array<string>)")))).alias("alias")).filter("trim(alias) <> ''").distinct()
    r = p.select(F.explode("p.relations").alias("r")).select("r.*").distinct()
    known = lambda name: concepts.select(F.col("concept_id").alias(name))
    return concepts, aliases, r.join(known("source"), "source", "left_semi").join(known("target"), "target", "left_semi")


def golden_set(packs: DataFrame) -> DataFrame:
    """(doc_id, content, subject, predicate, object): expected claims of labelled documents; one without any has a row of nulls."""
    g = packs.select(F.explode(F.from_json("value", GOLDEN)["documents"]).alias("g")).select("g.*")
    return g.select("doc_id", "content", F.explode_outer("expected_claims").alias("c")).select("doc_id", "content", "c.*")


def scraped_posts(lines: DataFrame) -> DataFrame:
    """Documents of a fallback scraper, whose fields have several names; posts without id or text are left out."""
    j = lambda *paths: F.coalesce(*[F.nullif(F.get_json_object("value", f"$.{x}"), F.lit("")) for x in paths])
    n = lambda *paths: F.coalesce(j(*paths).try_cast("long"), F.lit(0).cast("long"))
    out = lines.select(
        F.concat(F.lit("twitter_"), j("id", "tweet_id", "rest_id")).alias("id"), T.cleaned(j("text", "full_text", "content")).alias("content"), F.try_to_timestamp(j("created_at", "date", "timestamp")).alias("timestamp"), j("author.username", "user.screen_name", "username").alias("author_name"),
        n("author.followers", "user.followers_count").alias("author_followers"), n("likes", "favorite_count", "metrics.likes").alias("likes"), n("retweets", "retweet_count", "metrics.retweets").alias("shares"), n("replies", "reply_count", "metrics.replies").alias("comments"),
    )
    return out.filter("id is not null and content <> ''")
