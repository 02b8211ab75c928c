"""Operators for training-data pipelines. Nothing else in weftline imports this subpackage."""
