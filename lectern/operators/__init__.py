"""DataFrame operators. Column names are parameters; order-sensitive ones take an explicit ``seq`` column."""
