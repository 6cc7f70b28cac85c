"""Preparation of training text: ten document operators, their queries and their pipeline stages.

Nothing else in the library imports this subpackage.
"""
