"""dialoom: conversation-log analytics expressed as PySpark DataFrame plans."""
