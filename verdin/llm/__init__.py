"""Operators for training-data pipelines over large document tables.

Each module holds one operator with its own general interface; ``queries`` binds them to the
``opN_<name>`` queries.  Nothing outside this subpackage imports it.
"""
