"""DataFrame operators (each ``f(df, *, columns/params) -> DataFrame``)."""
