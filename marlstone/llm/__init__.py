"""Training-data operators over document, page and benchmark tables.

Nothing outside this subpackage imports it.
"""
