"""Sources, sinks, formats and schemas."""
