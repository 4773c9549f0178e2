"""An analytics engine for property graphs of source code and similar linked data, on Spark DataFrames."""
