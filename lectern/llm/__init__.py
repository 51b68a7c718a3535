"""Training-data operators: language ID, BPE, licences, exact and near dedup, mixing, PII, lines, secrets, quality.

Nothing outside this package imports it.  Each module holds one operator with a general interface;
``queries`` registers the thin ``opN_*`` queries over the test tables.
"""
