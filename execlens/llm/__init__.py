"""Training-data operators: packing, mixing, archives, deduplication, search and formatting.

Nothing outside this subpackage imports it.  Each module holds one operator with a general
interface; :mod:`execlens.llm.queries` binds the operators to the driver's tables.
"""
