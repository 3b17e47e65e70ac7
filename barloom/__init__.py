"""Market-bar features, signals and order decisions as Spark jobs over long, ticker-keyed tables."""
