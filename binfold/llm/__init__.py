"""Training-data operators over document, vector and media tables.

Nothing else in the package imports this subpackage.
"""
