"""All queries of the library's core, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from waylake.plans import builds, documents, feeds, inventory, places, streams

MODULES = [feeds, inventory, documents, places, streams, builds]
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
