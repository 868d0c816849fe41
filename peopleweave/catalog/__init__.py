"""All registered queries."""
from . import (registry, sources_sinks, normalisation, filters, joins, aggregates, windows, evidence_index, search, resolution, people, streams, extensions, plans)  # noqa: F401

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
