"""The per-row pipeline as a stream."""
