"""Queries of the engine, registered by module."""

from notewright.plans import deep_queries, inventory_queries, model_queries, more_queries, note_queries, order_queries, overview_queries, page_queries, read_queries, record_queries, rule_queries, run_queries, source_queries, spell_queries, store_queries, text_queries  # noqa: F401
from notewright.plans.registry import ORACLES, QUERIES  # noqa: F401
