"""Operators for large training-text pipelines. Nothing else in the package imports this one."""
