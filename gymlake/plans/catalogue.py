"""Registry: query name to plan, and the SQL it is compared with."""

from __future__ import annotations

from gymlake.plans import bank, bank_store, evidence, files, lookups, playbooks, rates, records, reports, scores, states, streams, study, texts

_MODULES = (scores, rates, study, bank, texts, states, playbooks, reports, records, files, streams, evidence, bank_store, lookups)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
