"""helixloom: sequencing and comparative genomics on Spark DataFrames."""
