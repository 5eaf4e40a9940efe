"""Operators for preparing training data at corpus scale.

Each module holds one operator as functions from DataFrame to DataFrame.
Nothing outside this subpackage imports it; ``queries`` lists what it offers
to ``__spark_entry__``.
"""
