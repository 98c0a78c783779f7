"""tidelog: a PySpark-native engine for multi-version keyed data.

An append-only log of ``(k, seq, op, v)`` records is a DataFrame; snapshot
resolution, seeks, scans, batches, sorted tables, manifests and recovery are
declarative plans over it.
"""
