"""Lexicon layer: persons, companies, addresses, custom names and ethnicities by word lists and context."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.functions import fixed
from cloakwork.functions.matching import HIT, SPAN, alternation, as_hits, find_all, strip_prefixes, strip_words


@dataclass(frozen=True)
class Lexicon:
    """The word lists; each can be read from a file with sources.lexicons.load_terms."""

    surnames: list[str] = field(default_factory=lambda: list(fixed.SURNAMES))
    ethnicities: list[str] = field(default_factory=lambda: list(fixed.ETHNICITIES))
    stopwords: list[str] = field(default_factory=lambda: list(fixed.STOPWORDS))
    prompts: list[str] = field(default_factory=lambda: list(fixed.PROMPTS))
    titles: list[str] = field(default_factory=lambda: list(fixed.TITLES))
    regions: list[str] = field(default_factory=lambda: list(fixed.REGIONS))
    custom_names: list[str] = field(default_factory=list)

    def prefixes(self) -> list[str]:
        """Prompts, then titles, each longest first: the order in which they are taken off."""
        by_length = lambda words: sorted(words, key=lambda w: -len(w))
        return by_length(self.prompts) + by_length(self.titles)


def near_stopword(text: Column, start: Column, end: Column, lex: Lexicon) -> Column:
    """Whether a stopword in the hit's surroundings (four characters on both sides) holds the hit or lies in it."""
    begin = F.greatest(start - 4, F.lit(0))
    window = F.substr(text, begin + 1, end + 4 - begin)
    hit = F.substr(text, start + 1, end - start)
    words = F.array(*[F.lit(w) for w in lex.stopwords])
    return F.exists(words, lambda w: F.contains(window, w) & (F.contains(w, hit) | F.contains(hit, w)))


def valid_name(name: Column, lex: Lexicon) -> Column:
    """No stopword, not the name of an institution, and led by a surname."""
    institution = name.rlike("(?:" + "|".join(fixed.NAME_BAD_SUFFIX) + r")\z")
    return ~name.isin(*lex.stopwords) & ~institution & name.rlike(f"^(?:{alternation(lex.surnames)})")


def _no_stopword(value: Column, lex: Lexicon) -> Column:
    return ~F.exists(F.array(*[F.lit(w) for w in lex.stopwords]), lambda w: F.contains(value, w))


def _names(text: Column, spans: Column, lex: Lexicon) -> Column:
    return F.filter(spans, lambda s: valid_name(s["text"], lex) & ~near_stopword(text, s["start"], s["end"], lex))


def _filled(pattern: str, name: str, words: list[str]) -> str:
    return pattern.replace(f"<{name}>", alternation(words))


def judicial_persons(text: Column, lex: Lexicon) -> Column:
    spans = find_all(text, fixed.NAME, _filled(fixed.JUDICIAL_LEAD, "titles", lex.titles), fixed.NAME_END, alternation(lex.titles)) if lex.titles else F.array().cast(SPAN)
    return as_hits(_names(text, spans, lex), "person", 0.85, "lexicon", True)


def prompted_persons(text: Column, lex: Lexicon) -> Column:
    spans = find_all(text, fixed.NAME, _filled(fixed.PROMPTED_LEAD, "prompts", lex.prompts), fixed.NAME_END) if lex.prompts else F.array().cast(SPAN)
    return as_hits(_names(text, spans, lex), "person", 0.85, "lexicon")


def gendered_persons(text: Column, lex: Lexicon) -> Column:
    return as_hits(_names(text, find_all(text, fixed.NAME, after=fixed.GENDER_TAIL, need="，[男女]"), lex), "person", 0.85, "lexicon")


def persons(text: Column, lex: Lexicon) -> Column:
    """Judicial, prompted and gendered persons; of equal spans the first stays."""

    def add(acc: Column, h: Column) -> Column:
        known = F.exists(acc, lambda a: (a["start"] == h["start"]) & (a["end"] == h["end"]))
        return F.when(known, acc).otherwise(F.concat(acc, F.array(h)))

    found = F.concat(judicial_persons(text, lex), prompted_persons(text, lex), gendered_persons(text, lex))
    return F.aggregate(found, F.array().cast(f"array<{HIT}>"), add)


def _stripped(spans: Column, prefixes: list[str]) -> Column:
    """Spans without leading prompts and function words; the start moves along."""

    def strip(s: Column) -> Column:
        value = strip_words(strip_prefixes(s["text"], prefixes), fixed.LEADING_BAD)
        return F.struct((s["end"] - F.length(value)).alias("start"), s["end"].alias("end"), value.alias("text"))

    return F.transform(spans, strip).cast(SPAN)


def companies(text: Column, lex: Lexicon) -> Column:
    """Names that end like a company. Law firms are stopwords and so never found."""
    spans = _stripped(find_all(text, fixed.COMPANY, need=fixed.COMPANY_NEED), lex.prefixes())
    return as_hits(F.filter(spans, lambda s: (F.length(s["text"]) >= 4) & _no_stopword(s["text"], lex)), "company", 0.80, "lexicon")


def addresses(text: Column, lex: Lexicon) -> Column:
    """Places with a road or building word; six characters or more without blanks."""
    spans = _stripped(find_all(text, fixed.ADDRESS, need=fixed.ADDRESS_NEED), list(fixed.ADDRESS_PREFIXES))
    long = lambda s: F.length(F.translate(s["text"], " 　", "")) >= 6
    return as_hits(F.filter(spans, long), "address", 0.70, "lexicon")


def region_addresses(text: Column, lex: Lexicon) -> Column:
    """Four to 25 characters behind a region's name, unless they end like an institution."""
    if not lex.regions:
        return as_hits(F.array().cast(SPAN), "address", 0.65, "lexicon")
    lead = _filled(fixed.REGION_LEAD, "regions", lex.regions)
    spans = _stripped(find_all(text, lead + fixed.REGION_PLACE, after=fixed.REGION_END), lex.prefixes())
    ends = "(?:" + "|".join(fixed.ADDRESS_BAD_SUFFIX) + r")\z"
    return as_hits(F.filter(spans, lambda s: ~s["text"].rlike(ends) & _no_stopword(s["text"], lex)), "address", 0.65, "lexicon")


def custom_names(text: Column, lex: Lexicon) -> Column:
    """The user's own names, one after the other; confidence 0.9, so they need no confirmation."""
    parts = [F.filter(find_all(text, alternation([n])), lambda s: ~near_stopword(text, s["start"], s["end"], lex)) for n in lex.custom_names]
    return as_hits(F.concat(*parts) if parts else F.array().cast(SPAN), "person", 0.90, "custom")


def _apart(words: list[str]) -> bool:
    """Whether no two of the words can overlap in a text."""
    return not any(a != b and (a in b or any(a.endswith(b[:n]) for n in range(1, len(b)))) for a in words for b in words)


def ethnicities(text: Column, lex: Lexicon) -> Column:
    """All terms of the list, those that overlap others too. One search serves terms that can't."""
    groups = [lex.ethnicities] if _apart(lex.ethnicities) else [[w] for w in lex.ethnicities]
    parts = [find_all(text, alternation(g)) for g in groups if g]
    return as_hits(F.concat(*parts) if parts else F.array().cast(SPAN), "ethnicity", 0.90, "lexicon")


LAYERS = {
    "persons": persons, "companies": companies, "addresses": addresses,
    "region_addresses": region_addresses, "custom_names": custom_names, "ethnicities": ethnicities,
}


def all_lexicon_hits(text: Column, lex: Lexicon) -> Column:
    """Hits of the whole layer in its order of emission. A text without an ideograph or a word of the lists that has none
    is passed over by one search; a null text has no hits."""
    plain = [w for words in (lex.titles, lex.prompts, lex.regions, lex.custom_names, lex.ethnicities) for w in words if not any("一" <= c <= "龥" for c in w)]
    need = "|".join(["[一-龥]", *(alternation([w]) for w in plain)])
    return F.when(text.rlike(need), F.concat(*[f(text, lex) for f in LAYERS.values()])).otherwise(F.array().cast(f"array<{HIT}>"))
