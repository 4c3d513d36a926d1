"""palisade: secret and personal-data scanning analytics as Spark DataFrame jobs."""
