"""Sources, sinks and model calls."""
