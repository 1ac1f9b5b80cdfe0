"""DataFrame operators: audit, splits, sampling, metrics, runs, extraction, governance, media."""
