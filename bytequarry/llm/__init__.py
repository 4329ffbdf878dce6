"""Training-data operators: filters, extraction, deduplication, search and packing over text tables.

Nothing outside this subpackage imports it. Every operator takes DataFrames and column names and
returns a DataFrame; the thin ``opN_<name>`` queries are in :mod:`bytequarry.llm.queries`.
"""
