"""Queries on posts: events, customers and parts spell them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import posts as P, text as X
from .bind import table
from .registry import query

_EMOJI = "CASE event_id % 7 WHEN 0 THEN 'to the 🚀🚀 moon 🌙' WHEN 1 THEN 'down 📉 and 💀' WHEN 2 THEN '🚀🚀🚀 buy' WHEN 3 THEN 'plain, ' || event_type || ' — \"ok\" 100%!' WHEN 4 THEN '⚠️ 🐻🐻🐻🐻' WHEN 5 THEN '' ELSE 'gold 💎🙌 ✅' END"
_TOTAL = " + ".join(f"(length(x) - length(replace(x, '{e}', ''))) * {w}::DOUBLE" for e, w in P.EMOJI_WEIGHTS.items())


def _posts(spark, d):
    return table(spark, d, "events").select("event_id", F.expr(_EMOJI).alias("x"), "value")


def _spelled(x):
    for e, w in P.EMOJI_WORDS.items():
        x = f"replace({x}, '{e}', '{w}')"
    return x


@query(f"SELECT event_id, {_spelled(_EMOJI)} AS words FROM events")
def emoji_words(spark, d):
    return _posts(spark, d).select("event_id", P.emoji_words(F.col("x")).alias("words"))


_MODIFIER = f"m AS (SELECT event_id, x, value, least(0.5, greatest(-0.5, {_TOTAL})) AS m FROM (SELECT event_id, {_EMOJI} AS x, value FROM events))"


@query(f"WITH {_MODIFIER} SELECT event_id, round(m, 6) AS modifier FROM m")
def emoji_modifier(spark, d):
    return _posts(spark, d).select("event_id", F.round(P.emoji_modifier(F.col("x")), 6).alias("modifier"))


@query(f"""WITH {_MODIFIER}, s AS (SELECT event_id, m, least(0.9, abs(value) % 100 / 100) AS p, 0.1 * (1 - least(0.9, abs(value) % 100 / 100)) AS n FROM m), t AS (SELECT event_id, m, p, n, 1 - p - n AS u FROM s),
c AS (SELECT *, least(1.0, greatest(0.0, CASE WHEN m > 0 THEN p + m * (1 - p) ELSE p + m * p * 0.7 END)) AS p2, least(1.0, greatest(0.0, CASE WHEN m > 0 THEN n - m * n * 0.7 ELSE n - m * (1 - n) END)) AS n2, least(1.0, greatest(0.0, u - abs(m) * u * 0.3)) AS u2 FROM t)
SELECT event_id, CAST(floor(CASE WHEN m = 0 THEN p ELSE round(p2 / (p2 + n2 + u2), 4) END * 20 + 0.013) AS BIGINT) AS positive, CAST(floor(CASE WHEN m = 0 THEN n ELSE round(n2 / (p2 + n2 + u2), 4) END * 20 + 0.013) AS BIGINT) AS negative FROM c""")
def shifted_sentiment(spark, d):
    p = F.least(F.lit(0.9), F.abs("value") % 100 / 100)
    rows = _posts(spark, d).select("event_id", p.alias("p"), (0.1 * (1 - p)).alias("n"), P.emoji_modifier(F.col("x")).alias("m")).withColumn("u", 1 - F.col("p") - F.col("n"))
    s = rows.select("event_id", P.shifted_scores(F.col("p"), F.col("n"), F.col("u"), F.col("m")).alias("s"))
    return s.select("event_id", F.floor(F.col("s.positive") * 20 + 0.013).alias("positive"), F.floor(F.col("s.negative") * 20 + 0.013).alias("negative"))


@query(rf"""SELECT event_id, trim(regexp_replace(regexp_replace({_EMOJI}, '[^\pL\pN_\s$%.,!?''"-]', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM events""")
def model_text(spark, d):
    return _posts(spark, d).select("event_id", P.model_text(F.col("x")).alias("text"))


@query("""WITH e AS (SELECT event_id, event_id % 2 = 0 AS tw, CASE event_id % 3 WHEN 0 THEN 'user123456' ELSE 'Ann' END AS author, CASE WHEN event_id % 5 > 0 THEN user_id * 10 END AS followers, event_id % 11 = 0 AS verified, CAST(floor(value) AS BIGINT) % 7 AS likes, CASE WHEN event_id % 4 = 0 THEN 'hi!!!!!!!' ELSE 'hi!' END AS x FROM events),
s AS (SELECT event_id, list_filter([CASE WHEN tw AND author = 'user123456' THEN 0.6 END, CASE WHEN tw AND followers > 1000 AND likes < 5 THEN 0.4 END, CASE WHEN tw AND verified THEN -0.5 END, CASE WHEN x = 'hi!!!!!!!' THEN 0.2 END], lambda v: v IS NOT NULL) AS l FROM e)
SELECT event_id, round(CASE WHEN len(l) = 0 THEN 0 ELSE greatest(0, least(1, list_sum(l) / len(l))) END::DOUBLE, 6) AS bot FROM s""")
def bot_scores(spark, d):
    k = F.col("event_id")
    bot = P.bot_score(F.when(k % 4 == 0, "hi!!!!!!!").otherwise("hi!"), F.when(k % 3 == 0, "user123456").otherwise("Ann"), F.when(k % 5 > 0, F.col("user_id") * 10), k % 11 == 0, F.floor("value").cast("long") % 7, F.lit(0), F.lit(0), F.lit(None).cast("double"), k % 2 == 0)
    return table(spark, d, "events").select("event_id", F.round(bot, 6).alias("bot"))


#: Texts, the tickers they name, and whether they are of the sector.
_TICKER_CASES = [
    ("buy $nvda and $XYZQ now", ["NVDA"], True), ("NASDAQ: AMD up", ["AMD"], True), ("Micron (MU) said (no)", ["MU"], True), ("please STOP here", [], False), ("STOP shares rose", ["STOP"], True), ("a stop is a stop", [], False), ("nvidea chips", ["NVDA"], True),
    ("lamb stew", [], False), ("Lam   Research rose", ["LRCX"], True), ("wafer fab at 3nm", [], True), ("", [], False), ("BRK.B and AMD-WT", ["BRK.B"], True), ("x$AMD e$MU ($MU)", ["AMD", "MU"], True), ("STOP +5%", ["STOP"], True),
]
_UNIVERSE, _NAMES, _AMBIGUOUS, _KEYWORDS = {"NVDA", "AMD", "MU", "STOP", "LRCX", "BRK.B"}, {"nvidia": "NVDA", "micron": "MU", "lam research": "LRCX"}, {"STOP"}, ["wafer", "hbm", "nic"]


def _cases(k):
    return " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(k))


_N = len(_TICKER_CASES)


@query(f"SELECT c_custkey, CASE c_custkey % {_N} {_cases(chr(39) + ','.join(t) + chr(39) for _, t, _ in _TICKER_CASES)} END AS tickers, CASE c_custkey % {_N} {_cases(r for *_, r in _TICKER_CASES)} END AS relevant FROM customer")
def ticker_mentions(spark, d):
    text = F.expr(f"CASE c_custkey % {_N} {_cases(chr(39) + x + chr(39) for x, *_ in _TICKER_CASES)} END")
    rows = table(spark, d, "customer").select("c_custkey", text.alias("x")).withColumn("t", P.tickers(_UNIVERSE, _NAMES, _AMBIGUOUS)("x"))
    return rows.select("c_custkey", F.concat_ws(",", "t").alias("tickers"), P.relevant(F.col("x"), _KEYWORDS, F.col("t")).alias("relevant"))


@query("SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN '10-K' WHEN 1 THEN '8-K' WHEN 2 THEN 'DEF 14A' WHEN 3 THEN 'SC 13D' ELSE '8-K' END AS form, CASE n_nationkey % 4 WHEN 0 THEN 'Ai_Chip Demand' ELSE 'memory' END AS label, CASE n_nationkey % 4 WHEN 0 THEN 'real_gdp__q' ELSE 'cpi' END AS tag FROM nation".replace("'Ai_Chip Demand'", "'Ai Chip Demand'"))
def normal_names(spark, d):
    k = F.col("n_nationkey")
    form = F.when(k % 5 == 0, " 10-k/a").when(k % 5 == 1, "8k").when(k % 5 == 2, "DEF14A").when(k % 5 == 3, "sc 13d/a").otherwise("NT 10-K")
    return table(spark, d, "nation").select("n_nationkey", X.filing_type(form).alias("form"), X.humanized(F.when(k % 4 == 0, "ai_chip_demand").otherwise("memory")).alias("label"), X.factor_tag(F.when(k % 4 == 0, " Real GDP -Q").otherwise("CPI")).alias("tag"))
