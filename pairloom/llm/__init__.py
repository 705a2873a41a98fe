"""Training-data operators: sharding, quality, language, decontamination, packing, dedup, token store, LM, secrets.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
