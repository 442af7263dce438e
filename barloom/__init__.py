"""barloom: daily-bar analytics and ledger processing on Spark DataFrames."""
