"""Spark-native record-linkage, risk-signal and corpus engine.

Every computed signal is a lead to verify, never a finding; every flag carries its evidence; demographic attributes are never scored.
"""
