"""Training-data operators: thirteen corpus-scale components, each a module, and their registered queries.

Nothing outside this subpackage imports it.
"""
