"""Queries over the test tables; importing the modules registers them."""

from ledgerloom.plans import calls, checks, citations, filings, fundamentals, funds, history, market, metrics, monitoring, portfolio, reads, records, returns, rules, stories, technical, universe, valuation
from ledgerloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "calls", "checks", "citations", "filings", "fundamentals", "funds", "history", "market", "metrics", "monitoring", "portfolio", "reads", "records", "returns", "rules", "stories", "technical", "universe", "valuation"]
