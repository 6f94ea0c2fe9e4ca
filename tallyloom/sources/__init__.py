"""Statement files: delimited text, positioned text, inferred profiles, idempotent ingest."""
