"""Training-data operators: search, mixing, packing, extraction, deduplication, scoring, sharding.

Each module holds one operator with a general interface; ``queries`` derives
the registered ``opN_*`` results from them.  Nothing outside this subpackage
imports it.
"""
