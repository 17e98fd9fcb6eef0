"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chat, media, mixing, quality_mil, quality_rules, simhash, substring_dedup, suffix_dedup, toxicity

MODULES = (quality_mil, toxicity, substring_dedup, quality_rules, mixing, bpe, simhash, media, chat, suffix_dedup)

QUERIES = {name: f for module in MODULES for name, f in vars(module).items() if name.startswith("op") and name[2].isdigit()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
