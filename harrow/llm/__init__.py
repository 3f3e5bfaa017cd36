"""Training-data operators: ten corpus components and the queries that apply them.

Nothing outside this subpackage imports it, so the folder can be removed.
"""
