"""Training-data operators: dedup, decontamination, language ID, tokenising, sharding, WARC, ANN.

Nothing outside this package imports it; ``queries.py`` registers one query per operator.
"""
