"""Event-time decision analytics expressed as Spark DataFrame plans."""
