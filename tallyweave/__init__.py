"""Bill-ledger analytics on Spark."""
