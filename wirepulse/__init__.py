"""Detection of business events in news items, as Spark DataFrame operators."""
