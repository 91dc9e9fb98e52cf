"""Table operators: ``f(df, ...) -> DataFrame``, lazy unless documented otherwise."""
