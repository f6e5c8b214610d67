"""Training-data operators: packing, filters, near-duplicates, search, text extraction, tokens, mixing.

Nothing outside this subpackage imports it.  ``sigloom.llm.queries`` registers one query per operator.
"""
