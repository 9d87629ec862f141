"""Structured Streaming jobs: file intake, scan progress, coalesced recomputation."""
