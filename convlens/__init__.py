"""convlens: conversation analytics on Spark."""
