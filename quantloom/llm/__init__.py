"""Operators for preparing language-model training data at scale.

Nothing outside this subpackage imports it.  Each module holds one operator with
a general interface; :mod:`quantloom.llm.queries` binds them to whole tables.
"""
