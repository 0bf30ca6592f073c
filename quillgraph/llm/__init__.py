"""Training-data operators: scans, packing, near-duplicate search, learned labels.

One module per operator; nothing outside this package imports it.  Every
operator takes and returns DataFrames, and `queries.py` binds each of them to
the tables of the driver.
"""
