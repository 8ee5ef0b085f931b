"""Operators for training-data pipelines. Nothing else in gridloom imports this subpackage."""
