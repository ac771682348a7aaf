"""Structured Streaming: sources with watermarks, emit modes, stateful operators, subscriptions."""
