"""All queries of the subpackage, and the SQL of those that SQL can express."""

from cloakwork.llm import chat_format, decontaminate, iblt, language, line_dedup, pieces, simhash, token_counts, toxicity, url_filter

_MODULES = (decontaminate, iblt, url_filter, toxicity, language, simhash, pieces, chat_format, token_counts, line_dedup)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
