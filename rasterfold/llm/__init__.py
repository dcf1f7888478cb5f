"""Training-data operators: chat formatting, packing, search, tokenising, deduplication, classifiers, sharding, licenses.

Nothing else in the library imports this subpackage.
"""
