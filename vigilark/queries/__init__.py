"""The query catalogue: every entry is a callable (spark, directory) -> DataFrame, most with a SQL counterpart."""
