"""All queries of the engine's own operators, with the SQL that must give the same rows."""

from __future__ import annotations

from keyloom.plans import dictionary, ingest

QUERIES = {**ingest.QUERIES, **dictionary.QUERIES}
SQL = {**ingest.SQL, **dictionary.SQL}
