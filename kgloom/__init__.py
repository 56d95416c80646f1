"""Knowledge-graph question answering as batch jobs on Spark DataFrames."""
