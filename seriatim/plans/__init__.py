"""The registered queries: each a Spark job and, where SQL can say it, the same question in SQL."""
