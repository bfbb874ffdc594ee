"""Movie sources and sinks."""
