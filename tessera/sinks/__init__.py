"""Files written from DataFrames."""
