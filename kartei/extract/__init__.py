"""Content extractors, run in Arrow batches with row-level quarantine."""
