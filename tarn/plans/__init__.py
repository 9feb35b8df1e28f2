"""Plan helpers (lineage, session, dense identifiers) and the query suite."""
