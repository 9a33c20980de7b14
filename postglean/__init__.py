"""postglean: message-risk analytics and text-corpus processing on Spark DataFrames."""
