"""Operators for training-data pipelines. Nothing outside this folder imports it, but for the guarded entry point."""
