"""Supply-chain exception analytics on Spark."""
