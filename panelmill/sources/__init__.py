"""Sources, sinks and the durable hand-off between stages."""
