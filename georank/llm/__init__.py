"""Training-data operators: mixing, language ID, toxicity, packing, search, dedup, licences and LM scoring.

Nothing else in the library imports this subpackage.
"""
