"""Slip, ledger and conversation analytics expressed as Spark DataFrame jobs."""
