"""Operators for preparing training data at scale.

Each module holds one operator; ``queries`` registers them with production
parameters. Nothing outside this subpackage imports it.
"""
