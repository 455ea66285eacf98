"""Registered queries: fixture views put through the operators, with SQL for comparison."""

from tallyweave.plans import q_datasets, q_ledger, q_records, q_scoring, q_sources, q_streaming  # noqa: F401
