"""Landing-limit analytics for commercial fish tickets, expressed as Spark DataFrame plans."""
