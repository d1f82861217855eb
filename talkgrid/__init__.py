"""talkgrid: conversation and knowledge analytics on Spark DataFrames."""
