"""The queries of this subpackage, their SQL, and the corpus pipeline."""

from __future__ import annotations

import importlib

_MODULES = ("sharding", "langid", "toxicity", "media", "packing", "contain", "minhash", "lm", "substring", "suffix")


def queries() -> dict:
    found = {}
    for name in _MODULES:
        module = importlib.import_module(f"tesserae.llm.queries_{name}")
        found |= {k: f for k, f in vars(module).items() if k.startswith("op") and k[2:3].isdigit()}
    found["pipeline"] = importlib.import_module("corpus_pipeline").run
    return dict(sorted(found.items(), key=lambda kv: (len(kv[0].split("_")[0]), kv[0])))


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in _MODULES:
        found |= getattr(importlib.import_module(f"tesserae.llm.queries_{name}"), "ORACLE_SQL", {})
    if sql := importlib.import_module("corpus_pipeline").ORACLE_SQL:
        found["pipeline"] = sql
    return found
