"""Scalar and aggregate functions as Column builders; Python only where no built-in can express them."""
