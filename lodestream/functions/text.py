"""Text rules as column expressions; all run on the JVM."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F

# Fixed values
PROMOTIONS = [
    r"\b(join|check out)\s+(my|our)\s+(discord|telegram|channel)\b",
    r"\bDM\s+me\b",
    r"\blink\s+in\s+bio\b",
    r"\bfree\s+(signals?|picks?|tips?)\b",
    r"\bguaranteed\s+(gains?|profits?|returns?)\b",
    r"\b\d+%\s+guaranteed\b",
]
QUANTITY = r"(?i)^\s*(\$)?\s*(\d[\d,]*(?:\.\d+)?)\s*(billion|million|thousand|nm|units?|weeks?|months?|days?|[bmk]|%)?\s*$"
SCALES = {"billion": 1e9, "b": 1e9, "million": 1e6, "m": 1e6, "thousand": 1e3, "k": 1e3}
UNITS = {"%": "%", "nm": "nm", "unit": "count", "units": "count", "week": "weeks", "weeks": "weeks", "month": "months", "months": "months", "day": "days", "days": "days"}
MISSING = ["", ".", "-", "--", "na", "n/a", "none", "null", "nan"]
FILINGS = ["10-K", "10-Q", "8-K", "DEF 14A", "S-1", "S-3", "20-F", "6-K", "SC 13D", "SC 13D/A", "SC 13G", "SC 13G/A", "4", "13F-HR"]
FILING_ALIASES = {"10K": "10-K", "10Q": "10-Q", "8K": "8-K", "DEF14A": "DEF 14A", "SC13D": "SC 13D", "SC13G": "SC 13G", "13F": "13F-HR", "FORM 4": "4"}
RUMOR = r"(?i)\b(?:reportedly|rumor(?:s|ed)?|sources?\s+say|speculat\w*|allegedly)\b"
ESTIMATE = r"(?i)\b(?:analysts?|estimat\w*|consensus|projected\s+by)\b"
GUIDED = r"(?i)\b(?:expect\w*|plan(?:s|ned|ning)?|will|forecast\w*|project\w*|target\w*|guidance|guide[sd]?|aim(?:s|ing)?|intends?|to\s+build)\b"


def lookup(key: Column, table: dict, default=None) -> Column:
    found = F.lit(default)
    for k, v in table.items():
        found = F.when(key == k, F.lit(v)).otherwise(found)
    return found


def normalized(text: Column) -> Column:
    """Runs of white space as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def cleaned(text: Column) -> Column:
    """Normalised, without control characters."""
    return F.regexp_replace(normalized(text), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def words(text: Column) -> Column:
    """Lower-cased words split at white space, none empty."""
    return F.filter(F.split(F.lower(text), r"[ \t\r\n]+"), lambda w: w != "")


def stable_hash(value: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(value, 256), 1, n)


def keyed_id(prefix: str, *parts: Column, n: int = 16) -> Column:
    """prefix_ and n hex digits of the SHA-256 of the lower-cased parts joined by NUL."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\0", *[F.lower(F.trim(p)) for p in parts]), 256), 1, n))


def exact_fingerprint(content: Column, kind: Column, title: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.sha2(F.concat_ws("\0", normalized(blank(content)), blank(kind), blank(title)), 256)


def cashtags(text: Column) -> Column:
    """Distinct $TICKER symbols, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(r"\$([A-Z]{1,5})\b"), 1)))


def urls(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(https?://[^ \t\r\n<>\"]+)"), 1))


def _shapes(texts: pd.Series) -> pd.DataFrame:
    """Shares and numbers of words, which are held for one text at a time."""

    def shape(words: list[str]) -> tuple[float, int]:
        return (max(Counter(words).values()) / len(words) if words else 0.0), len(words)

    found = [shape((x or "").lower().split()) for x in texts]
    return pd.DataFrame({"share": [s for s, _ in found], "n": pd.array([n for _, n in found], "int32")})


def word_shape(text: Column) -> Column:
    """struct(share of the most frequent word, 0 without words; number of words): counted in one pass of a batch, where the JVM would sort and fold arrays."""

    @F.pandas_udf("struct<share double, n int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield _shapes(texts)

    return run(text)


def spam_score(text: Column, n_urls: Column, author: Column, followers: Column, n_tickers: Column, is_twitter: Column) -> Column:
    """Capped sum of the content, author and platform rules."""
    on = lambda rule, points: F.when(F.coalesce(rule, F.lit(False)), points).otherwise(0.0)
    shout = (F.upper(text) == text) & (F.lower(text) != text) & (F.length(text) > 20)
    promo = reduce(lambda a, b: a | b, [text.rlike(f"(?i){p}") for p in PROMOTIONS])
    shape, name = word_shape(text), F.lower(author)
    guru = reduce(lambda a, b: a | b, [name.contains(x) for x in ("crypto_", "trading_", "forex_", "_signals")])
    rockets = F.length(text) - F.length(F.replace(text, F.lit("🚀"), F.lit("")))
    total = (
        on(F.length(text) < 20, 0.2) + on(shout, 0.15) + on(promo, 0.4) + on(n_urls > 3, 0.2) + on((shape["share"] > 0.3) & (shape["n"] > 10), 0.2)
        + on(name.rlike(r"^[a-z]+\d{6,}$"), 0.3) + on(guru, 0.2)
        + on(is_twitter & (followers < 10), 0.2) + on(is_twitter & (n_tickers > 5), 0.3) + on(is_twitter & (rockets > 3), 0.2)
    )
    return F.least(F.lit(1.0), total)


def engagement(likes: Column, shares: Column, comments: Column, ratio: Column) -> Column:
    return (likes + 2 * shares + comments) * F.coalesce(ratio, F.lit(1.0))


def quantity(raw: Column) -> Column:
    """struct(value, unit) of a written quantity; null when it is none."""
    group = lambda k: F.regexp_extract(raw, QUANTITY, k)
    suffix = F.lower(group(3))
    value = F.regexp_replace(group(2), ",", "").try_cast("double") * lookup(suffix, SCALES, 1.0)
    unit = F.when(group(1) == "$", "USD").otherwise(lookup(suffix, UNITS, "count"))
    return F.when(raw.rlike(QUANTITY), F.struct(value.alias("value"), unit.alias("unit")))


def number(raw: Column) -> Column:
    """A number as data files write it: missing marks, (negative), separators and signs of currency or percent."""
    t = F.lower(F.trim(raw))
    body = F.regexp_replace(F.regexp_replace(t, r"[,$%]", ""), r"^\((.*)\)$", "-$1")
    return F.when(t.isin(*MISSING), None).otherwise(body.try_cast("double"))


def modality(text: Column) -> Column:
    return F.when(text.rlike(RUMOR), "rumor").when(text.rlike(ESTIMATE), "estimate").when(text.rlike(GUIDED), "guided").otherwise("reported")


def html_text(html: Column, drop: tuple[str, ...] = ("script", "style", "nav", "footer", "header")) -> Column:
    """Text of a page without the elements in drop, tags and the five named entities."""
    t = html
    for tag in drop:
        t = F.regexp_replace(t, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    t = F.regexp_replace(t, "(?s)<[^>]*>", " ")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " "), ("amp", "&")):
        t = F.replace(t, F.lit(f"&{name};"), F.lit(char))
    return normalized(t)


def padded(text: Column) -> Column:
    """The lower-cased text between two blanks before and one behind."""
    return F.concat(F.lit("  "), F.lower(text), F.lit(" "))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the padded text."""
    x = padded(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: F.substring(x, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    return both / (F.size(x) + F.size(y) - both)


def mentions(text: Column, term: str) -> Column:
    """Non-overlapping occurrences, case ignored."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(term.lower()), F.lit("")))) / len(term)).cast("int")


def humanized(identifier: Column) -> Column:
    """Underscored identifiers as titles, others as they are, nothing as Unknown."""
    t = F.trim(F.coalesce(identifier, F.lit("")))
    return F.when(t == "", "Unknown").when(t.contains("_"), F.initcap(F.trim(F.replace(t, F.lit("_"), F.lit(" "))))).otherwise(t)


def factor_tag(value: Column) -> Column:
    return F.translate(F.lower(F.trim(value)), " -", "__")


def innovation_alias(value: Column) -> Column:
    """Lower case without forms of incorporation, letters and digits only."""
    t = F.regexp_replace(F.lower(F.trim(value)), r"\b(inc|incorporated|corp|corporation|co|company|ltd|llc)\b\.?", "")
    return F.trim(F.regexp_replace(t, r"[^a-z0-9]+", " "))


def metric_of(event_type: Column, action: Column, unit: Column) -> Column:
    """What a numeric fact of an event measures; null for other events."""
    invested = (F.coalesce(unit, F.lit("")) == "USD") | F.coalesce(action.rlike("(?i)invest|spend|capex|capital"), F.lit(False))
    return (
        F.when(event_type == "price_change", "price").when(event_type == "guidance_change", "guidance").when(event_type.isin("product_launch", "product_delay"), "product_timing")
        .when(event_type == "capacity_expansion", F.when(invested, "capex").otherwise("capacity")).when(event_type == "capacity_constraint", F.when(unit.isin("weeks", "months", "days"), "lead_time").otherwise("capacity"))
    )


def claim_sentence(subject: Column, predicate: Column, obj: Column, metric: Column, value: Column, unit: Column, period: Column, modality: Column) -> Column:
    """A claim as a sentence: subject, predicate, object, and the numeric fact with what is known of it."""
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    whole = F.when(value == F.floor(value), F.floor(value).cast("long").cast("string")).otherwise(value.cast("string"))
    fact = F.concat_ws(" ", metric, whole, some(unit), some(period), F.when(some(modality).isNotNull(), F.concat(F.lit("("), modality, F.lit(")"))))
    return F.concat_ws(" ", some(subject), some(F.replace(predicate, F.lit("_"), F.lit(" "))), some(obj), F.when(some(metric).isNotNull() & value.isNotNull(), fact))


def version_id(*settings: tuple[str, Column]) -> Column:
    """mv_ and 12 hex digits over the settings as JSON with sorted keys."""
    parts = [F.concat(F.lit(f'"{k}": '), F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)) for k, c in sorted(settings)]
    return F.concat(F.lit("mv_"), F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256), 1, 12))


def filing_type(raw: Column) -> Column:
    """Upper-cased form without /A; aliases to their form, unknown ones to 8-K."""
    t = F.regexp_replace(F.upper(F.trim(raw)), "/A$", "")
    return F.when(t.isin(*FILINGS), t).otherwise(lookup(t, FILING_ALIASES, "8-K"))


def period_of(reference: Column, year: Column) -> Column:
    """Q2 2025, second quarter of 2025, H1 2025, 2025 and so on as 2025-Q2, 2025-H1, 2025; null if not understood."""
    q = F.regexp_extract(reference, r"(?i)\bQ([1-4])\b", 1)
    h = F.regexp_extract(reference, r"(?i)\bH([12])\b", 1)
    y = F.regexp_extract(reference, r"\b(20\d\d|19\d\d)\b", 1)
    yy = F.when(y != "", y).otherwise(year.cast("string"))
    word = reduce(lambda acc, kv: F.when(F.lower(reference).contains(f"{kv[0]} quarter"), kv[1]).otherwise(acc), [("first", "1"), ("second", "2"), ("third", "3"), ("fourth", "4")], F.lit(""))
    return F.when(q != "", F.concat(yy, F.lit("-Q"), q)).when(word != "", F.concat(yy, F.lit("-Q"), word)).when(h != "", F.concat(yy, F.lit("-H"), h)).when(y != "", y)
