"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface and a thin ``opN_<name>`` query over the test tables.
"""
