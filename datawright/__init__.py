"""Data preparation and data quality on Spark DataFrames.

``sources``: reading, row identity, fingerprints and versions. ``functions``: cell-level Column builders.
``operators``: profiling, diagnosis, drift, time series, panel, linkage, privacy, preprocessing, charts.
``plans``: findings, policy, validation, contracts, learned rules, repair, review and workflow.
``streaming``: validation of micro-batches.
"""

__version__ = "0.1.0"
