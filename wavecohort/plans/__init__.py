"""Composed results: collection status, series, waveforms, ingest."""
