"""Campaign-event analytics expressed as Spark DataFrame jobs.

``functions``  column expressions (casts, rules, ratios)
``operators``  DataFrame -> DataFrame steps (split, dedup, conform, keys, fact, checks)
``sources``    contracts, scans, adapters and sinks
``plans``      the layers built from them (bronze, silver, gold) and their SQL forms
"""
