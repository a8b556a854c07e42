"""The queries of this subpackage and their SQL."""

from lattica.llm import decontaminate, exact_dedup, mixing, recompress, secrets, simhash, sst, suffix_dedup, toxicity, warc

MODULES = [secrets, sst, simhash, warc, decontaminate, toxicity, mixing, exact_dedup, recompress, suffix_dedup]

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: q for m in MODULES for k, q in m.ORACLE_SQL.items() if q}
