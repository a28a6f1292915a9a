"""The grammar of events: forms of verbs, sentences, odd texts, and the operator around it."""

from __future__ import annotations

import pytest

from lodestream.functions import event_grammar as G
from lodestream.operators import entities


@pytest.mark.parametrize("verb,want", [("raise", "raise raises raised raising"), ("miss", "miss misses missed missing"), ("slip", "slip slips slipped slipping"), ("supply", "supply supplies supplied supplying"), ("cut", "cut cuts cutting"), ("delay", "delay delays delayed delaying"), ("launch", "launch launches launched launching"), ("open", "open opens opened opening"), ("ramp up", "ramp up,ramps up,ramped up,ramping up")])
def test_forms(verb, want):
    assert G.forms(verb) == tuple(want.split("," if "," in want else " "))


@pytest.mark.parametrize(
    "text,kind,actor,thing,amount",
    [
        ("TSMC is expanding fab capacity in Arizona by $40 billion.", "capacity_expansion", "TSMC", "fab capacity", "$40 billion"),
        ("Samsung announced a new fabrication facility in Taylor Texas.", "capacity_expansion", "Samsung", "new fabrication facility", None),
        ("Intel invests $20 billion in new chip manufacturing capacity.", "capacity_expansion", "Intel", "new chip manufacturing capacity", "$20 billion"),
        ("Advanced packaging supply shortage continues to impact AI chip delivery.", "capacity_constraint", None, "Advanced packaging", None),
        ("Lead times extended to 30 weeks for mature nodes.", "capacity_constraint", None, "Lead times", "30 weeks"),
        ("GlobalFoundries is unable to meet customer demand for automotive chips.", "capacity_constraint", "GlobalFoundries", "customer demand", None),
        ("Intel begins mass production of Emerald Rapids processors.", "product_launch", "Intel", "Emerald Rapids processors", None),
        ("$NVDA NVIDIA launched the H200 GPU.", "product_launch", "NVIDIA", "H200 GPU", None),
        ("The Blackwell chip has been pushed back to next quarter.", "product_delay", None, "Blackwell chip", None),
        ("Arrow Lake desktop processors are behind schedule by 3 months.", "product_delay", None, "Arrow Lake desktop processors", "3 months"),
        ("TSMC raised wafer prices by 5% for advanced nodes.", "price_change", "TSMC", "wafer prices", "5%"),
        ("Memory chip prices surged 20% due to strong AI demand.", "price_change", None, "Memory chip prices", "20%"),
        ("AMD expects revenue of $6.5 billion in Q1 2026.", "guidance_change", "AMD", "revenue", "$6.5 billion"),
        ("NVIDIA beat Wall Street estimates on strong demand.", "guidance_change", "NVIDIA", "Wall Street estimates", None),
        ("Intel warned of lower earnings due to weak PC demand.", "guidance_change", "Intel", "lower earnings", None),
    ],
)
def test_sentences(text, kind, actor, thing, amount):
    found = list(G.events(f"Nothing before. {text} Nothing after."))
    assert [(e.kind, e.actor, e.object, e.quantity) for e in found] == [(kind, actor, thing, amount)]
    assert f"Nothing before. {text}"[found[0].start : found[0].end] in text


@pytest.mark.parametrize("text", ["", "x", "The weather in San Francisco is sunny today with clear skies.", "The company held its annual board meeting in New York.", "raised", "raised prices", "Prices.", "launched the launched the", "Intel expects revenue to grow."])
def test_no_events(text):
    assert list(G.events(text)) == []


def test_every_rule_has_a_trigger_and_a_kind():
    assert len(G.KINDS) == 6 and all(r.verbs or r.phrases for r in G.RULES)


def test_operator_on_odd_rows(spark):
    many = "TSMC raised wafer prices by 5%. " * 80
    rows = [(1, "TSMC raised wafer prices by 5% in Q3. NVIDIA launched the H200 GPU.", ["TSMC", None, "AMD"]), (2, None, ["X"]), (None, "AMD delayed the chip.", None), (3, "", None), (4, many, None), (1, "AMD delayed the chip.", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tickers array<string>")
    out = entities.pattern_events(docs, {"NVDA"}, {}, tickers="tickers", year=None).collect()
    first = [r for r in out if r["doc_id"] == 1 and r["event_type"] == "price_change"][0]
    assert first["tickers"] == ["TSMC"] and abs(first["confidence"] - 1.0) < 1e-9
    assert sum(r["doc_id"] == 4 for r in out) == entities.EVENT_MOST and sum(r["doc_id"] is None for r in out) == 1 and not any(r["doc_id"] in (2, 3) for r in out)
    assert [r["span_start"] for r in out if r["doc_id"] == 4] == [32 * k for k in range(50)]
    dated = entities.pattern_events(docs, {"NVDA"}, {}, year=docs["doc_id"].cast("int") + 2024).filter("doc_id = 1 and event_type = 'price_change'").first()
    assert dated["time_ref"] is None and dated["quantity"] == "5%"  # Q3 without a year is no time of the grammar
    sure = entities.pattern_events(docs, set(), {}, least=0.85).collect()
    assert sure and all(r["confidence"] >= 0.85 for r in sure)
    assert entities.pattern_events(docs.limit(0), set(), {}).count() == 0
