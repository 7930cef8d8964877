"""Market-surveillance analytics expressed as Spark DataFrame operators."""
