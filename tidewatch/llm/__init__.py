"""Training-data operators: near-dedup, classifiers, URL rules, fingerprints, packing, mixing.

Each operator module takes DataFrames and column names; ``queries`` registers one
query per operator over the driver's tables.  Nothing outside this subpackage
imports it.
"""
