"""pluvia: flood-risk analytics over daily observations, as Spark DataFrame jobs."""
