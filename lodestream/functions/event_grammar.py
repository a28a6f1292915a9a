"""A small grammar of events in financial prose.

A clause tells an event if it has a trigger (a form of one of a rule's verbs, or a fixed phrase)
and, next to it, an object with one of the rule's head nouns.  Rules are rows of a
table; one builder makes the triggers' forms by the rules of English inflection, and one
reader takes actor, object, quantity and time from the clause around the trigger.  So a new event is
a new row, not a new expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

VOWELS = "aeiou"
IRREGULAR = {"cut": ("cut", "cuts", "cutting"), "build": ("build", "builds", "built", "building"), "rise": ("rise", "rises", "rose", "risen", "rising"), "fall": ("fall", "falls", "fell", "fallen", "falling"), "begin": ("begin", "begins", "began", "begun", "beginning"), "bring": ("bring", "brings", "brought", "bringing"), "beat": ("beat", "beats", "beaten", "beating"), "grow": ("grow", "grows", "grew", "growing"), "outstrip": ("outstrip", "outstrips", "outstripped", "outstripping"), "debut": ("debut", "debuts", "debuted", "debuting"), "sell": ("sell", "sells", "sold", "selling")}


def forms(verb: str) -> tuple[str, ...]:
    """The forms of a verb; particles after it stay."""
    verb, *particle = verb.split(" ", 1)
    if verb in IRREGULAR:
        out = IRREGULAR[verb]
    else:
        third = f"{verb[:-1]}ies" if verb.endswith("y") and verb[-2] not in VOWELS else f"{verb}es" if re.search(r"(s|x|z|ch|sh)$", verb) else f"{verb}s"
        short = re.fullmatch(r"[^aeiou]+[aeiou][bdgmnpt]", verb)
        stem = verb[:-1] if verb.endswith("e") else verb + verb[-1] if short else verb
        past = f"{verb[:-1]}ied" if verb.endswith("y") and verb[-2] not in VOWELS else f"{stem}ed"
        out = (verb, third, past, f"{stem}ing")
    return tuple(" ".join([f, *particle]) for f in out)


@dataclass(frozen=True)
class Rule:
    """An event type and how it is told.

    verbs and phrases trigger it; its object has one of nouns (any object, if there are none) and stands
    after the trigger, before it, or either way; ``amount``: a quantity must follow.
    """

    kind: str
    verbs: tuple[str, ...] = ()
    nouns: tuple[str, ...] = ()
    place: str = "after"
    phrases: tuple[str, ...] = ()
    amount: bool = False
    actor: bool = True


OUTPUT = ("capacity", "production", "manufacturing", "output", "fab", "fabs", "wafer starts", "production line", "production lines")
SITES = ("fab", "plant", "factory", "facility", "foundry")
PRICES = ("price", "prices", "pricing")
FIGURES = ("revenue", "earnings", "sales", "profit", "income", "margin", "margins")
OUTLOOKS = ("guidance", "forecast", "outlook", "target", "targets")
SHORTAGES = ("shortage", "shortages", "constraint", "constraints", "bottleneck", "bottlenecks", "yield issue", "yield issues", "yield problems")
RULES = (
    Rule("capacity_expansion", ("expand", "increase", "ramp", "ramp up", "boost", "scale", "scale up", "double", "triple", "add"), OUTPUT, "either"),
    Rule("capacity_expansion", ("plan", "announce", "build", "open", "construct"), SITES),
    Rule("capacity_expansion", ("invest",), (), amount=True),
    Rule("capacity_expansion", ("announce",), ("investment", "expansion", "upgrade")),
    Rule("capacity_constraint", ("face", "report", "experience", "encounter"), SHORTAGES),
    Rule("capacity_constraint", ("halt", "suspend", "cut", "reduce"), OUTPUT),
    Rule("capacity_constraint", ("allocate", "ration"), ("supply", "wafers", "chips", *OUTPUT)),
    Rule("capacity_constraint", phrases=("unable to meet",), nouns=("demand",)),
    Rule("capacity_constraint", phrases=("fully booked", "fully allocated", "fully committed", "sold out"), nouns=("capacity",), place="before", actor=False),
    Rule("capacity_constraint", ("extend", "lengthen", "stretch"), ("lead time", "lead times"), "before", actor=False),
    Rule("capacity_constraint", ("exceed", "outpace", "outstrip"), ("demand",), "before", actor=False),
    Rule("capacity_constraint", phrases=("supply shortage", "shortage", "bottleneck", "undersupply"), place="before", actor=False),
    Rule("product_delay", ("delay", "postpone", "push back", "reschedule"), (), "either"),
    Rule("product_delay", ("slip",), (), "before", actor=False),
    Rule("product_delay", phrases=("behind schedule",), place="before", actor=False),
    Rule("price_change", ("raise", "hike", "increase", "cut", "lower", "reduce", "slash", "discount"), PRICES),
    Rule("price_change", ("rise", "increase", "surge", "jump", "climb", "soar", "fall", "drop", "decline", "decrease", "tumble"), (*PRICES, "cost", "costs"), "before", actor=False),
    Rule("guidance_change", ("raise", "lower", "cut", "update", "revise", "maintain", "reaffirm", "reiterate", "withdraw"), OUTLOOKS),
    Rule("guidance_change", ("expect", "project", "forecast", "guide for"), FIGURES, amount=True),
    Rule("guidance_change", ("beat", "miss", "exceed", "top", "surpass"), ("estimates", "expectations", "consensus", "forecasts")),
    Rule("guidance_change", ("warn", "warn of"), (*FIGURES, "demand")),
    Rule("guidance_change", ("report",), FIGURES, amount=True),
    Rule("guidance_change", ("expand", "contract", "improve", "narrow", "widen"), ("margin", "margins"), "before"),
    Rule("product_launch", ("launch", "introduce", "unveil", "release", "debut", "roll out", "reveal", "preview"), ()),
    Rule("product_launch", ("begin mass production of", "start mass production of", "start volume shipments of", "sample", "tape out"), ()),
    Rule("product_launch", ("announce",), ("chip", "processor", "gpu", "cpu", "accelerator", "memory", "module", "platform", "device", "card", "server", "system", "node")),
    Rule("product_launch", ("enter mass production", "enter volume production"), (), "before", actor=False),
)
KINDS = tuple(dict.fromkeys(r.kind for r in RULES))

CLAUSE = re.compile(r"[.!?;]+(?=\s|$)|\n")
#: Words between an actor and its verb, and words before an object that are no part of it.
HELPERS = r"(?:\s+(?:is|are|was|were|has|have|had|been|being|will|would|to|also|now|plans?|expected|set|continues?))*"
ARTICLES = r"(?:(?:the|a|an|its|their|some)\s+)*"
ACTOR_AT_END = re.compile(rf"((?:(?<![$\w])[A-Z][\w&'-]*)(?:\s+(?:&\s+)?[A-Z][\w&'-]*){{0,4}}){HELPERS}\s*$")
LEADING = frozenset(("The", "A", "An", "This", "In", "On", "By", "For", "Shares", "Its", "Their"))
STOPS = r"(?:to|until|till|by|in|for|on|at|due|during|from|with|of|after|before|as|than|and|because|this|next|last)\b|[,:()\"]|\$?\d[\d.,]*\s*(?:%|billion|million)"
AMOUNT = re.compile(r"\$?\d[\d,]*(?:\.\d+)?\s*(?:%|percent|billion|million|thousand|bn|nm|units?|weeks?|months?|quarters?|[BMK]\b)|\$\d[\d,]*(?:\.\d+)?", re.IGNORECASE)
MONTHS = "January February March April May June July August September October November December".split()
TIME = re.compile(rf"\b(?:[QH][1-4]\s*(?:of\s+)?(?:19|20)\d\d|(?:first|second|third|fourth)\s+quarter(?:\s+(?:of\s+)?(?:19|20)\d\d)?|next\s+(?:quarter|year|month)|(?:{'|'.join(f'{m[:3]}(?:{m[3:]})?' if m[3:] else m for m in MONTHS)})\.?,?\s+(?:19|20)\d\d|end\s+of\s+the\s+year|year[\s-]end|(?:19|20)\d\d)\b", re.IGNORECASE)
WORD = re.compile(r"\w+")
OBJECT_WORDS = 8


@dataclass(frozen=True)
class Event:
    kind: str
    actor: str | None
    action: str
    object: str | None
    quantity: str | None
    time: str | None
    start: int
    end: int


def either_of(words) -> str:
    return "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in sorted(set(words), key=lambda w: (-len(w), w)))


@cache
def triggers(rule: Rule) -> re.Pattern:
    return re.compile(rf"(?<![\w-])(?:{either_of([*rule.phrases, *(f for v in rule.verbs for f in forms(v))])})(?![\w-])", re.IGNORECASE)


@cache
def heads(rule: Rule) -> frozenset[str]:
    """The first words of a rule's triggers: an ASCII clause without any of them has no trigger."""
    return frozenset(w.split()[0].lower() for w in [*rule.phrases, *(f for v in rule.verbs for f in forms(v))])


@cache
def nouns(rule: Rule) -> re.Pattern:
    return re.compile(rf"(?<![\w-])(?:{either_of(rule.nouns)})(?![\w-])", re.IGNORECASE)


def any_trigger(rules: tuple[Rule, ...] = RULES) -> str:
    """An expression that every text with an event matches."""
    return rf"(?i)\b(?:{either_of(w for r in rules for w in [*r.phrases, *(f for v in r.verbs for f in forms(v))])})\b"


def _after(rule: Rule, rest: str) -> tuple[int, int] | None:
    """Where the object lies in what follows a trigger."""
    begin = re.match(rf"\s+(?:up\s+)?{ARTICLES}", rest)
    if not begin:
        return None
    if rule.amount and (m := AMOUNT.match(rest, begin.end())):  # invests $2 billion in something
        begin = re.compile(rf"\s*(?:in\s+)?{ARTICLES}").match(rest, m.end())
    words = re.compile(r"[\w&'%/+-]+(?:\s+|$)?").finditer(rest, begin.end())
    end, count, stop = begin.end(), 0, re.compile(STOPS, re.IGNORECASE)
    for w in words:
        if w.start() != end or stop.match(rest, w.start()) or count == OBJECT_WORDS:
            break
        end, count = w.end(), count + 1
    if rule.nouns:
        found = [m.end() for m in nouns(rule).finditer(rest, begin.end(), end)]
        if not found:
            return None
    text = rest[begin.end() : end].rstrip()
    return (begin.end(), begin.end() + len(text)) if text else None


def _before(rule: Rule, left: str) -> tuple[int, int] | None:
    """Where the object lies in what precedes a trigger."""
    cut = re.search(rf"{HELPERS}\s*$", left).start()
    words = list(re.finditer(r"[\w&'%/+-]+", left[:cut]))[-OBJECT_WORDS:]
    if not words or left[words[-1].end() : cut].strip():
        return None
    begin = words[-1].start()
    for a, b in zip(reversed(words[:-1]), reversed(words[1:]), strict=True):
        if left[a.end() : b.start()].strip():
            break
        begin = a.start()
    begin += re.match(rf"{ARTICLES}", left[begin:cut], re.IGNORECASE).end()
    if rule.nouns and not nouns(rule).search(left, begin, cut):
        return None
    return (begin, cut) if begin < cut else None


def _actor(left: str) -> tuple[int, int] | None:
    m = ACTOR_AT_END.search(left)
    if not m:
        return None
    begin, end = m.span(1)
    while (word := left[begin:end].split(" ", 1))[0] in LEADING:
        if len(word) == 1:
            return None
        begin += len(word[0]) + 1
    return begin, end


def events(text: str, rules: tuple[Rule, ...] = RULES) -> Iterator[Event]:
    """The events of a text, rule by rule; they may overlap."""
    clauses, at = [], 0
    for m in [*CLAUSE.finditer(text), None]:
        end = m.start() if m else len(text)
        clause = text[at:end]
        clauses.append((at, clause, frozenset(WORD.findall(clause.lower())) if clause.isascii() else None))
        at = m.end() if m else end
    for rule in rules:
        for base, clause, words in clauses:
            if words is not None and words.isdisjoint(heads(rule)):
                continue
            for m in triggers(rule).finditer(clause):
                left, rest = clause[: m.start()], clause[m.end() :]
                actor = _actor(left) if rule.actor else None
                after = _after(rule, rest) if rule.place in ("after", "either") and actor else None
                before = _before(rule, left) if rule.place in ("before", "either") and not after else None
                if not (after or before):
                    continue
                if before and rule.place == "either":
                    actor = None
                amount = AMOUNT.search(rest)
                if rule.amount and not amount:
                    continue
                time = TIME.search(rest)
                spans = [m.span(), *([actor] if actor else []), *([before] if before else [])]
                spans += [(m.end() + s[0], m.end() + s[1]) for s in (after, amount and amount.span(), time and time.span()) if s]
                thing = clause[slice(*before)] if before else rest[slice(*after)]
                clean = lambda x: x.strip().rstrip(",. ") or None
                yield Event(rule.kind, clean(clause[slice(*actor)]) if actor else None, clean(m[0]), clean(thing), clean(amount[0]) if amount else None, clean(time[0]) if time else None, base + min(s[0] for s in spans), base + max(s[1] for s in spans))
