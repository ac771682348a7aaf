"""SQL front end: statements of the engine, and query extensions rewritten for Spark."""
