"""The queries of this subpackage and, where SQL can express one, its SQL."""

from importlib import import_module

MODULES = ("queries_topk", "queries_warc", "queries_mixing", "queries_decontaminate", "queries_html", "queries_minhash", "queries_lm", "queries_langid", "queries_tokens", "queries_repeats")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f".{m}", __package__).QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in MODULES for k, q in import_module(f".{m}", __package__).SQL.items()}
