"""Words that speak for or against a thesis."""

from __future__ import annotations

# Fixed values
AUTHORITY = ["analyst", "report", "filing", "sec", "10-k", "10-q", "earnings", "management", "ceo", "cfo", "cto", "conference call", "guidance", "institutional", "research", "published", "peer-reviewed", "bloomberg", "reuters", "wsj", "ft", "semiconductor", "foundry", "tsmc", "intel", "samsung", "asml", "applied materials"]
EVIDENCE = ["revenue", "margin", "growth", "yoy", "qoq", "billion", "million", "percent", "%", "units", "shipments", "wafers", "capacity", "capex", "r&d", "forecast", "estimate", "data", "survey", "benchmark", "test", "measured", "confirmed", "reported", "according to", "source", "cited", "study"]
HYPE = ["moon", "rocket", "lambo", "guaranteed", "can't lose", "easy money", "to the moon", "diamond hands", "yolo", "fomo", "pump", "100x", "1000x", "infinite", "skyrocket", "explode", "no brainer", "free money", "trust me", "insane", "parabolic", "generational", "once in a lifetime"]
RISK = ["risk", "downside", "bear case", "concern", "challenge", "headwind", "uncertainty", "competition", "threat", "however", "although", "despite", "caveat", "warning", "caution", "overvalued", "bubble", "correction", "pullback", "worst case", "geopolitical", "regulation", "tariff", "sanction", "shortage"]
ACTION = ["buy", "sell", "hold", "target", "price target", "entry", "position", "accumulate", "trim", "hedge", "overweight", "underweight", "allocation", "portfolio", "thesis", "catalyst", "timeline", "horizon", "strategy", "trade", "opportunity", "upside", "conviction"]
TECHNICAL = ["node", "nm", "process", "euv", "gate-all-around", "finfet", "gaafet", "chiplet", "hbm", "ddr5", "pcie", "interposer", "backside power", "tsv", "packaging", "lithography", "transistor", "wafer", "die", "yield", "defect density", "nand", "dram", "sram", "logic", "analog", "power", "gpu", "tpu", "npu", "asic", "fpga", "soc", "ip core", "arm", "risc-v", "x86", "fab", "etch", "deposition", "cmp"]
