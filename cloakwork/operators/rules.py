"""Rule layer: numbers found by patterns and checksums, confidence 0.99."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.functions.checksums import VALIDATORS
from cloakwork.functions.fixed import RULES
from cloakwork.functions.matching import HIT, as_hits, find_all


def rule_hits(text: Column, rule: str) -> Column:
    """Hits of one rule. A match that fails its checksum is used up all the same. A null text has none."""
    r = RULES[rule]
    spans = find_all(text, r.value, r.before, r.after, r.need)
    if r.check:
        spans = F.filter(spans, lambda s: VALIDATORS[r.check](s["text"]))
    return as_hits(spans, r.category, 0.99, "rule")


def all_rule_hits(text: Column, rules: tuple[str, ...] = tuple(RULES)) -> Column:
    """Hits of the rules, one after the other; a text without what any of them needs is passed over by one search."""
    need = "(?Ud)" + "|".join(dict.fromkeys(RULES[r].need for r in rules))
    return F.when(text.rlike(need), F.concat(*[rule_hits(text, r) for r in rules])).otherwise(F.array().cast(f"array<{HIT}>"))
