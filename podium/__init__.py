"""Competition analytics as Spark DataFrame operators.

Subpackages
-----------
functions   column builders (text keys, value parsing, weights, bands, statistics)
sources     reading, slimming, merging, fingerprinting and publishing tables
streaming   incremental file ingest on Structured Streaming
plans       physical-plan helpers: size checks, pinning, distributed ordering
operators   the relational operators (quality, scoring, statistics, similarity ...)
catalog     the registered queries and their equivalent SQL
"""
