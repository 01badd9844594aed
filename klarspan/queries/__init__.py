"""The registered queries of the engine and their SQL, by family."""

from klarspan.queries import claims, code, dialog, domain, functions, plane, records, relations, risks, states, texts

FAMILIES = (claims, relations, plane, texts, states, code, records, domain, risks, functions, dialog)
QUERIES = {name: query for family in FAMILIES for name, query in family.QUERIES.items()}
ORACLES = {name: text for family in FAMILIES for name, text in family.ORACLES.items()}
