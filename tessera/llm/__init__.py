"""Training-data operators: ten stand-alone modules plus the queries that apply them.

Nothing outside this subpackage imports it.
"""
