"""The registered queries of the engine's own operators, with the SQL that gives the same rows."""
