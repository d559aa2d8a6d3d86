"""The registered queries: input views, Spark plans and their SQL twins."""
