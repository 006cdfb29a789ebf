"""Training-data operators: one module per operator, plus their queries.

Nothing else in the package imports this subpackage. ``queries`` registers
one query per operator; each operator module keeps a general interface.
"""
