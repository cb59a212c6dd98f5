"""Training-data operators: each module holds one operator with its own general interface.

Nothing outside this subpackage imports it; ``queries`` registers the contract queries.
"""
