"""Named entities: normal forms, overlaps, fuzzy names, relevance to themes; events by pattern."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import event_grammar as E, posts as P, text as T
from ..sources.scratch import parts as tasks

# Fixed values
FUZZY, EXACT_NAME, SHORTEST = 85, 0.95, 4
SEMANTIC_BASE, SEMANTIC_LEAST = 0.6, 0.5
EVENT_BASE, EVENT_LEAST, EVENT_MOST, EVENT_CONTEXT = 0.7, 0.5, 50, 200
TRIGRAM_LEAST, ONE_CANDIDATE, MORE_CANDIDATES = 0.4, 0.7, 0.6
#: Mentions and names of a block; pairs that a task holds at once.
BLOCK, CELLS = 65_536, 1 << 17


def normalized(entities: DataFrame, companies: DataFrame) -> DataFrame:
    """Adds normalized: tickers in upper case without $, companies by their known name (name, normalized) or in upper case, others as they are."""
    text = F.trim("text")
    known = companies.select(F.lower("name").alias("_k"), F.col("normalized").alias("_n")).dropDuplicates(["_k"])
    rows = entities.withColumn("_k", F.when(F.col("type") == "COMPANY", F.lower(text))).join(known, "_k", "left")
    form = F.when(F.col("type") == "TICKER", F.regexp_replace(F.upper(text), r"^\$+", "")).when(F.col("type") == "COMPANY", F.coalesce("_n", F.upper(text))).otherwise(text)
    return rows.withColumn("normalized", form).drop("_k", "_n")


def theme_relevance(text: Column, kind: Column, known_ticker: Column, theme_text: Column) -> Column:
    """How an entity fits a theme's words: 0.5 if they have it, 0.3 for a ticker of the sector, 0.2 for technologies and products."""
    on = lambda rule, x: F.when(F.coalesce(rule, F.lit(False)), x).otherwise(0.0)
    return F.least(F.lit(1.0), on(F.lower(theme_text).contains(F.lower(text)), 0.5) + on(known_ticker, 0.3) + on(kind.isin("TECHNOLOGY", "PRODUCT"), 0.2))


def semantic_relevance(similarity: Column, kind: Column, known_ticker: Column) -> Column:
    """The same by the cosine of entity and theme, which counts from a threshold on."""
    on = lambda rule, x: F.when(F.coalesce(rule, F.lit(False)), x).otherwise(0.0)
    return F.least(F.lit(1.0), F.when(similarity >= SEMANTIC_LEAST, SEMANTIC_BASE * similarity).otherwise(0.0) + on(known_ticker, 0.2) + on(kind.isin("TECHNOLOGY", "PRODUCT"), 0.1))


def without_overlaps(entities: DataFrame, by: str = "doc_id") -> DataFrame:
    """Entities (by, start, end, confidence, normalized, type) of which none overlaps another of its document.

    From left to right, longer first: a later one replaces an earlier only if it is longer and
    not less sure by more than 0.2, or surer by more than 0.3.  Then the first of each
    normal form and type stays.  One document's entities are one group; a task takes its documents
    one after another from sorted rows, without a frame for each.
    """
    names = entities.columns
    at = {c: names.index(c) for c in (by, "start", "end", "confidence", "normalized", "type")}
    start, end, sure, form, kind = (at[c] for c in ("start", "end", "confidence", "normalized", "type"))

    value = lambda x: float("nan") if x is None else x

    def chosen(group: list[tuple]) -> list[tuple]:
        kept: list[tuple] = []  # begin, end, confidence, row; what is null overlaps nothing
        for row in sorted(group, key=lambda r: (r[start] is None, r[start] or 0, r[end] is None, -(r[end] or 0))):
            e = (value(row[start]), value(row[end]), value(row[sure]), row)
            over = [i for i, k in enumerate(kept) if e[0] < k[1] and k[0] < e[1]]
            if not over:
                kept.append(e)
            for i in over:
                k = kept[i]
                if e[1] - e[0] > k[1] - k[0] and e[2] >= k[2] - 0.2 or e[2] > k[2] + 0.3:
                    del kept[i]
                    kept.append(e)
                    break
        first: dict[tuple, tuple] = {}
        for *_, row in kept:
            first.setdefault((row[form], row[kind]), row)
        return list(first.values())

    def run(batches):
        group: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[at[by]] != group[0][at[by]]:
                    out += chosen(group)
                    group = []
                group.append(row)
            schema = batch.schema
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
        if group:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in chosen(group)], f.type) for i, f in enumerate(schema)], schema=schema)

    return entities.repartition(by).sortWithinPartitions(by, "start").mapInArrow(run, entities.schema)


def company_mentions(names: dict[str, tuple[str, str]], threshold: int = FUZZY):
    """A column function: array of (text, start, end, normalized, ticker, confidence, source) of known names (lower case: normal form, ticker) in a text.

    A name that stands there counts as it is; of others, words of four letters or more
    that are similar enough.
    """

    @F.pandas_udf("array<struct<text:string,start:int,end:int,normalized:string,ticker:string,confidence:double,source:string>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def find(text):
            out, low = [], (text or "").lower()
            words = dict.fromkeys(w for w in low.split() if len(w) >= SHORTEST)
            for name, (form, ticker) in names.items():
                at = low.find(name)
                if at >= 0:
                    out.append((text[at : at + len(name)], at, at + len(name), form, ticker, EXACT_NAME, "lookup"))
                    continue
                for w in words:
                    if 200 * min(len(name), len(w)) >= threshold * (len(name) + len(w)) and (s := P.similarity(name, w)) >= threshold and (m := re.search(rf"\b{re.escape(w)}\b", low)):
                        out.append((text[m.start() : m.end()], m.start(), m.end(), form, ticker, s / 100, "fuzzy"))
            return out

        for texts in parts:
            yield texts.map(find)

    return run


def fuzzy_resolved(mentions: DataFrame, names: DataFrame, least: float = TRIGRAM_LEAST) -> DataFrame:
    """(mention, concept, confidence, similarity): the best concept by trigram similarity for each distinct mention that has one.

    mentions: mention; names: name, concept.  Names of one pattern share most of their trigrams,
    so nearly every mention is similar enough to nearly every name and no prefix of rare trigrams
    tells them apart.  Distinct mentions and names are dealt into blocks, every block of mentions
    meets every block of names, and a task compares them exactly (``_nearest``); no pair is ever a row.
    A block gives a mention's best concept and two of its concepts at most.  A single candidate is surer than several.
    """
    kind = names.schema["concept"].dataType
    m = mentions.select("mention").filter(F.col("mention").isNotNull()).distinct().withColumn("p", T.padded(F.trim("mention")))
    n = names.filter(F.col("name").isNotNull()).select(T.padded(F.trim("name")).alias("p"), "concept").distinct()
    blocks = F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(BLOCK))).cast("int")
    parts = m.agg(blocks.alias("mb")).crossJoin(n.agg(blocks.alias("nb")))
    of = lambda key, count: F.pmod(F.xxhash64(*key), F.col(count)).cast("int")
    left = m.crossJoin(F.broadcast(parts)).select("mention", "p", F.explode(F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda k: of(["mention"], "mb") * F.col("nb") + k)).alias("_g"))
    right = n.crossJoin(F.broadcast(parts)).select("concept", F.xxhash64("concept").alias("h"), "p", F.explode(F.transform(F.sequence(F.lit(0), F.col("mb") - 1), lambda k: k * F.col("nb") + of(["p", "concept"], "nb"))).alias("_g"))
    # numbered pairs of blocks go round the partitions, which aren't put together by the few bytes that their work has
    dealt = max(tasks(mentions), tasks(names))
    met = left.repartitionById(dealt, F.col("_g")).groupBy("_g").cogroup(right.repartitionById(dealt, F.col("_g")).groupBy("_g"))
    found = met.applyInArrow(lambda x, y: _nearest(x, y, least), f"mention string, similarity double, h long, concept {kind.simpleString()}")
    # two concepts of each block, of which the best is one, tell the best of all and whether there are several
    best = found.groupBy("mention").agg(F.max_by(F.struct("concept", "similarity"), F.struct("similarity", -F.col("h"))).alias("_b"), F.countDistinct(F.struct("concept")).alias("_n"))
    return best.select("mention", "_b.concept", F.when(F.col("_n") == 1, ONE_CANDIDATE).otherwise(MORE_CANDIDATES).alias("confidence"), "_b.similarity")


def _grams(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and trigrams (three code points in 64 bits) of padded texts, with repeats."""
    spelled = [x.decode("utf-8", "surrogateescape") for x in texts.cast(pa.binary()).to_pylist()]
    c = np.frombuffer("".join(spelled).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(spelled)), np.fromiter(map(len, spelled), np.int64, len(spelled)))
    inside = row[2:] == row[:-2]
    return row[:-2][inside], (c[:-2] | c[1:-1] << np.uint64(21) | c[2:] << np.uint64(42))[inside]


def _classes(mask: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of mask and size, and the pair of each text."""
    masks, of = np.unique(mask, return_inverse=True)
    width = int(size.max()) + 1
    both, of = np.unique(of * width + size, return_inverse=True)
    return masks[both // width], both % width, of


def _first_of(group: np.ndarray) -> np.ndarray:
    """Where each group of sorted numbers begins."""
    return np.flatnonzero(np.diff(group, prepend=-1))


def _nearest(mentions: pa.Table, names: pa.Table, least: float) -> pa.Table:
    """The best concept of a block for each mention and, if there is one, another that is similar enough: of equal ones that of the least hash.

    Up to 63 of the most frequent trigrams are bits of a mask.  Texts of one mask and number of trigrams
    are a class; the masks of two classes tell the similarity of members that share no other trigram, and a bound
    below that of those that do.  Those are found along lists of the other trigrams' names and counted exactly.
    So the greater of both is the best, and concepts that either finds are all there are.  As many trigrams
    go into the mask as make the least work.
    """
    schema = pa.schema([("mention", mentions.schema.field("mention").type), ("similarity", pa.float64()), ("h", pa.int64()), ("concept", names.schema.field("concept").type)])
    n_m, n_n = mentions.num_rows, names.num_rows
    if not n_m or not n_n:
        return schema.empty_table()
    (row_m, key_m), (row_n, key_n) = _grams(mentions.column("p")), _grams(names.column("p"))
    spelled, code = np.unique(np.concatenate((key_m, key_n)), return_inverse=True)
    v = len(spelled)
    sorted_m, sorted_n = (np.sort(row * v + c) for row, c in ((row_m, code[: len(row_m)]), (row_n, code[len(row_m) :])))
    (row_m, code_m), (row_n, code_n) = (np.divmod(x[_first_of(x)], v) for x in (sorted_m, sorted_n))
    a, b = np.bincount(row_m, minlength=n_m), np.bincount(row_n, minlength=n_n)
    often_m, often_n = np.bincount(code_m, minlength=v), np.bincount(code_n, minlength=v)
    work = often_m * often_n
    common = np.argsort(-work, kind="stable")[:63]
    common = common[work[common] > 0]
    bit = np.zeros(v, np.uint64)
    bit[common] = np.uint64(1) << np.arange(len(common), dtype=np.uint64)
    whole_m, whole_n = (np.bitwise_or.reduceat(bit[c], _first_of(row)) for row, c in ((row_m, code_m), (row_n, code_n)))  # each text has a trigram
    h = np.asarray(names.column("h").combine_chunks())

    least_work = None
    for k in sorted({min(k, len(common)) for k in (0, 4, 8, 16, 32, 63)}):
        some = np.uint64((1 << k) - 1)
        (bits_m, a_m, of_m), (bits_n, b_n, of_n) = _classes(whole_m & some, a), _classes(whole_n & some, b)
        cost = 3 * int(work.sum() - work[common[:k]].sum()) + len(a_m) * len(b_n)
        if least_work is None or cost < least_work[0]:
            least_work = cost, k, bits_m, a_m, of_m, bits_n, b_n, of_n
    _, k, bits_m, a_m, of_m, bits_n, b_n, of_n = least_work
    mask_m, mask_n = (x & np.uint64((1 << k) - 1) for x in (whole_m, whole_n))

    # the names of the least hash and of the least other one of each class
    order = np.lexsort((h, of_n))
    first = _first_of(of_n[order])
    one = order[first]
    differ = np.flatnonzero(h[order] != h[one][of_n[order]])
    two = np.full(len(b_n), -1)
    two[of_n[order[differ]][::-1]] = order[differ][::-1]
    s_class, one_class, two_class = np.full(len(a_m), -1.0), np.full(len(a_m), -1), np.full(len(a_m), -1)
    h_one = h[one]
    step = max(1, CELLS // len(b_n))
    for at in range(0, len(a_m), step):
        both = np.bitwise_count(bits_m[at : at + step, None] & bits_n).astype(np.int64)
        s = both / (a_m[at : at + step, None] + b_n - both)
        ok = s >= least
        best = s.max(axis=1)
        pick = np.where(s == best[:, None], h_one, np.iinfo(np.int64).max).argmin(axis=1)
        other = ok & ((h_one != h_one[pick][:, None]) | (two >= 0))
        to = other.argmax(axis=1)
        has, many = best >= least, other.any(axis=1)
        s_class[at : at + step] = np.where(has, best, -1.0)
        one_class[at : at + step] = np.where(has, one[pick], -1)
        two_class[at : at + step] = np.where(many, np.where(h_one[to] != h_one[pick], one[to], two[to]), -1)
    # of each mention: similarity and name of the best, names of other concepts, -1 where there is none
    s_best, best, others = s_class[of_m], one_class[of_m], [two_class[of_m]]
    b_s, b_one, b_two = np.full(n_m, -1.0), np.full(n_m, -1), np.full(n_m, -1)

    rare = np.ones(v, bool)
    rare[common[:k]] = False
    order = np.argsort(code_n, kind="stable")
    lists, cut = row_n[order], np.concatenate(([0], np.cumsum(often_n)))
    go = rare[code_m] & (often_n[code_m] > 0)
    row_m, code_m = row_m[go], code_m[go]
    size = often_n[code_m]
    until = np.cumsum(size)
    ends = np.flatnonzero(np.diff(row_m, append=n_m)) + 1  # of each mention
    through = until[ends - 1]
    at = 0
    while at < len(row_m):
        done = int(until[at - 1]) if at else 0
        to = int(ends[max(np.searchsorted(through, done + CELLS, side="right") - 1, np.searchsorted(ends, at, side="right"))])
        n = size[at:to]
        names_of = lists[np.repeat(cut[code_m[at:to]] - (until[at:to] - n - done), n) + np.arange(int(until[to - 1]) - done)]
        low = int(row_m[at])
        pairs = np.repeat((row_m[at:to] - low) * n_n, n) + names_of
        pairs.sort()
        head = _first_of(pairs)
        shared = np.diff(head, append=len(pairs))
        i, j = np.divmod(pairs[head], n_n)
        i += low
        both = np.bitwise_count(mask_m[i] & mask_n[j]) + shared
        s = both / (a[i] + b[j] - both)
        keep = np.flatnonzero((s >= least) & ((s >= s_best[i]) | (others[0][i] < 0)))
        at = to
        if not len(keep):
            continue
        i, j, s = i[keep], j[keep], s[keep]
        head = _first_of(i)
        mine = i[head]
        b_s[mine] = np.maximum.reduceat(s, head)
        top = np.flatnonzero(s == b_s[i])
        top = top[np.lexsort((h[j[top]], i[top]))]
        b_one[mine] = j[top[_first_of(i[top])]]
        rest = np.flatnonzero(h[j] != h[b_one[i]])
        if len(rest):
            head = _first_of(i[rest])
            b_two[i[rest[head]]] = j[rest[head]]

    by_list = (b_s > s_best) | ((b_s == s_best) & (b_s >= 0) & (h[b_one] < h[best]))
    others += [b_one, b_two, best]
    s_best, best = np.where(by_list, b_s, s_best), np.where(by_list, b_one, best)
    other = np.full(n_m, -1)
    for x in others:
        other = np.where((other < 0) & (x >= 0) & (h[x] != h[best]), x, other)
    found = [np.flatnonzero(x >= 0) for x in (best, other)]
    at = np.concatenate(found)
    to = pa.array(np.concatenate((best[found[0]], other[found[1]])))
    # another concept's similarity is at least this and at most the best one's
    s = np.concatenate((s_best[found[0]], np.full(len(found[1]), least)))
    return pa.Table.from_arrays([mentions.column("mention").take(pa.array(at)), pa.array(s), names.column("h").take(to), names.column("concept").take(to)], schema=schema)


EVENT = [("id", None), ("_year", pa.int32()), ("event_type", pa.string()), ("actor", pa.string()), ("action", pa.string()), ("object", pa.string()), ("time_ref", pa.string()), ("quantity", pa.string()), ("tickers", pa.list_(pa.string())), ("confidence", pa.float64()), ("span_start", pa.int64()), ("span_end", pa.int64())]


def pattern_events(docs: DataFrame, universe: set[str], names: dict[str, str], text: str = "text", id_col: str = "doc_id", tickers: str | None = None, year: Column | None = None, rules: tuple[E.Rule, ...] = E.RULES, least: float = EVENT_LEAST, most: int = EVENT_MOST) -> DataFrame:
    """Events of documents: type, captures, time as a period, tickers, confidence and span.

    Rules are tried in their order; an event that overlaps an earlier one doesn't count, and a document
    gives ``most`` events at most (the feature's own limit).  Tickers are those found close by and, of the
    document's own (column tickers), those that the event's text has.  Confidence: 0.7, and 0.1 for each of
    actor, ticker and quantity.  A time without a year belongs to ``year``.  Texts without any
    trigger are left out before Python sees them, the others are dealt to all tasks by id; a null text has no events.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.filter(F.col(text).rlike(E.any_trigger(rules))).select(F.col(id_col), F.col(text).alias("_text"), (F.col(tickers) if tickers else F.array().cast("array<string>")).alias("_own"), (F.lit(None) if year is None else year).cast("int").alias("_year"))
    schema = f"{id_col} {kind}, _year int, event_type string, actor string, action string, object string, time_ref string, quantity string, tickers array<string>, confidence double, span_start long, span_end long"

    def run(batches):
        find = P.ticker_finder(universe, names)
        for batch in batches:
            rows = []
            for key, x, own, when in zip(*[batch.column(c).to_pylist() for c in (id_col, "_text", "_own", "_year")], strict=True):
                taken: list[E.Event] = []
                found = []
                for e in E.events(x, rules):
                    if len(taken) >= most:
                        break
                    if any(e.start < t.end and e.end > t.start for t in taken):
                        continue
                    told = x[e.start : e.end].upper()
                    near = sorted({*find(x[max(0, e.start - EVENT_CONTEXT) : e.end + EVENT_CONTEXT]), *(t for t in own or () if t and t in told)})
                    sure = min(1.0, EVENT_BASE + 0.1 * (bool(e.actor) + bool(near) + bool(e.quantity)))
                    if sure >= least:
                        taken.append(e)
                        found.append((e.start, (key, when, e.kind, e.actor, e.action, e.object, e.time, e.quantity, near, sure, e.start, e.end)))
                rows += [r for _, r in sorted(found, key=lambda f: f[0])]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(EVENT)
            yield pa.RecordBatch.from_arrays([pa.array(c, batch.schema.field(id_col).type if n == "id" else t) for c, (n, t) in zip(columns, EVENT, strict=True)], names=[id_col if n == "id" else n for n, _ in EVENT])

    # small files hold much work: it is dealt out whatever their number
    found = base.repartition(tasks(docs), id_col).mapInArrow(run, schema)
    return found.withColumn("time_ref", T.period_of(F.col("time_ref"), F.col("_year"))).drop("_year")
