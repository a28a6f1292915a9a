"""Posts: emoji, bots, tickers in context, relevance to a sector."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from .text import engagement

# Fixed values
EMOJI_WORDS = {
    "🚀": " bullish ", "📈": " bullish ", "🌙": " bullish ", "💎": " holding ", "🙌": " holding ", "📉": " bearish ",
    "🐻": " bearish ", "🐂": " bullish ", "💰": " profit ", "🔥": " hot ", "⚠️": " warning ", "🎯": " target ",
}
EMOJI_WEIGHTS = {
    "🚀": 0.3, "📈": 0.2, "💎": 0.1, "🙌": 0.1, "💰": 0.15, "🤑": 0.15, "💪": 0.1, "🎯": 0.05, "✅": 0.05, "🏆": 0.1, "🟢": 0.1, "🌙": 0.15, "🔥": 0.15, "💵": 0.1, "🤝": 0.05, "👍": 0.05, "🎉": 0.1, "⭐": 0.05, "💯": 0.1,
    "📉": -0.2, "💩": -0.2, "🤡": -0.1, "❌": -0.2, "🔻": -0.15, "🩸": -0.15, "💀": -0.2, "🪦": -0.25, "🔴": -0.1, "😢": -0.1, "😱": -0.15, "😰": -0.1, "👎": -0.05, "🐻": -0.2, "💔": -0.1, "🆘": -0.15,
}
SYMBOL = r"[A-Za-z]{1,5}(?:[.-][A-Za-z]{1,2})?"
EXCHANGES = "NASDAQ|NYSE|AMEX|OTC|TSX|LSE|ASX|HKEX|TSE|SSE|SZSE"
MARKET = r"(?i)\b(stock|shares?|ticker|symbol|equity|earnings|guidance|revenue|price|target|pt|upgrade|downgrade|analyst|options?|calls?|puts?|volume|market\s+cap|buy|sell|hold|long|short|nasdaq|nyse|amex|otc)\b"
NUMBERS = r"[\+\-]?\d+(\.\d+)?\s*%|\$\s*\d"
CONTEXT, FUZZY, FUZZY_NAMES = 48, 80, 250


def emoji_words(text: Column) -> Column:
    """Market emoji as words."""
    for emoji, word in EMOJI_WORDS.items():
        text = F.replace(text, F.lit(emoji), F.lit(word))
    return text


def emoji_modifier(text: Column, most: float = 0.5) -> Column:
    """The sum of the emoji's weights, kept within most; texts without one are told by one search."""
    count = lambda e: F.length(text) - F.length(F.replace(text, F.lit(e), F.lit("")))
    total = sum((count(e) * w for e, w in EMOJI_WEIGHTS.items()), F.lit(0.0))
    return F.when(text.rlike("[" + "".join(EMOJI_WEIGHTS) + "]"), F.greatest(F.lit(-most), F.least(F.lit(most), total))).otherwise(0.0)


def shifted_scores(positive: Column, negative: Column, neutral: Column, modifier: Column) -> Column:
    """struct(positive, negative, neutral, label) moved towards the modifier's side and made a distribution again."""
    m, up = F.abs(modifier), modifier > 0
    pos = F.when(up, positive + m * (1 - positive)).otherwise(positive - m * positive * 0.7)
    neg = F.when(up, negative - m * negative * 0.7).otherwise(negative + m * (1 - negative))
    neu = neutral - m * neutral * 0.3
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    total = clamp(pos) + clamp(neg) + clamp(neu)
    part = lambda c, old: F.when(modifier == 0, old).when(total > 0, F.round(clamp(c) / total, 4)).otherwise(F.round(clamp(c), 4))
    a, b, c = part(pos, positive), part(neg, negative), part(neu, neutral)
    label = F.when((a >= b) & (a >= c), "positive").when(b >= c, "negative").otherwise("neutral")
    return F.struct(a.alias("positive"), b.alias("negative"), c.alias("neutral"), label.alias("label"))


def model_text(text: Column) -> Column:
    """Letters, digits and plain punctuation; everything else a blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}_\s$%.,!?'\"-]", " "), r"(?U)\s+", " "))


def bot_score(text: Column, author: Column, followers: Column, verified: Column, likes: Column, shares: Column, comments: Column, ratio: Column, is_twitter: Column) -> Column:
    """The mean of the signals that a post gives, 0 to 1, 0 without any."""
    no = F.lit(None).cast("double")
    signal = lambda rule, points: F.when(F.coalesce(rule, F.lit(False)), F.lit(points)).otherwise(no)
    found = F.array_compact(
        F.array(
            signal(is_twitter & author.rlike(r"^[A-Za-z]+\d{6,}$"), 0.6), signal(is_twitter & (followers > 1000) & (engagement(likes, shares, comments, ratio) < 5), 0.4), signal(is_twitter & verified, -0.5),
            signal(F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))) > 5, 0.2),
        )
    )
    mean = F.aggregate(found, F.lit(0.0), lambda a, x: a + x) / F.size(found)
    return F.when(F.size(found) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean))).otherwise(0.0)


def similarity(a: str, b: str) -> float:
    """100 * 2 * (longest common subsequence) / (both lengths)."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], (left + 1 if x == y else max(row[j], row[j - 1]))
    return 200.0 * row[-1] / (len(a) + len(b))


def ticker_finder(universe: set[str], names: dict[str, str], ambiguous: set[str] = frozenset(), fuzzy: int = FUZZY):
    """A function from a text to its sorted tickers.

    Cashtags, EXCHANGE: SYMBOL and (SYMBOL) count as they are, bare upper-case symbols too, but
    ambiguous ones only with market language or a number close by; names count as
    whole words, and one-word names by similarity where fewer than three tickers are found.
    """
    tagged = re.compile(rf"(?<![A-Za-z0-9_])\$({SYMBOL})\b|(?i:\b(?:{EXCHANGES})\s*[:\-]\s*({SYMBOL})\b)|\(((?-i:[A-Z]{{1,5}}(?:[.-][A-Z]{{1,2}})?))\)")
    bare, market, numbers = re.compile(r"\b[A-Z]{2,5}(?:[.-][A-Z]{1,2})?\b"), re.compile(MARKET), re.compile(NUMBERS)
    spelled = sorted(((k.strip().lower(), v) for k, v in names.items() if k.strip() and v in universe), key=lambda x: -len(x[0]))
    whole = [(re.compile(rf"\b{re.escape(k).replace(chr(92) + ' ', chr(92) + 's+')}\b"), v) for k, v in spelled]
    single = [(k, v) for k, v in spelled if " " not in k] if len(names) <= FUZZY_NAMES else []

    def find(text: str | None) -> list[str]:
        if not text:
            return []
        found = {s for m in tagged.finditer(text) if (s := m[m.lastindex].upper()) in universe}
        for m in re.finditer(rf"\$({SYMBOL})\b", text):  # a cashtag may follow what another rule took
            if (m.start() == 0 or not re.match(r"[A-Za-z0-9_]", text[m.start() - 1])) and m[1].upper() in universe:
                found.add(m[1].upper())
        for m in bare.finditer(text):
            if m[0] in universe and m[0] not in found:
                near = text[max(0, m.start() - CONTEXT) : m.end() + CONTEXT]
                if m[0] not in ambiguous or market.search(near) or numbers.search(near):
                    found.add(m[0])
        low = text.lower()
        found |= {v for p, v in whole if v not in found and p.search(low)}
        if len(found) < 3 and single:
            words = set(re.findall(r"[a-zA-Z]{4,}", low))
            for k, v in single:  # a word can't be similar enough if its length is too far off
                if v not in found and any(200 * min(len(k), len(w)) >= fuzzy * (len(k) + len(w)) and similarity(k, w) >= fuzzy for w in words):
                    found.add(v)
        return sorted(found)

    return find


def tickers(universe: set[str], names: dict[str, str], ambiguous: set[str] = frozenset(), fuzzy: int = FUZZY):
    """A column function: the tickers of a text."""

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = ticker_finder(universe, names, ambiguous, fuzzy)
        for texts in parts:
            yield texts.map(find)

    return run


def relevant(text: Column, keywords: list[str], found: Column) -> Column:
    """Whether a text has a keyword as a whole word, or a ticker."""
    return F.lower(text).rlike(r"\b(?:" + "|".join(re.escape(k) for k in keywords) + r")\b") | (F.size(found) > 0)
