"""Evidence-weighted phenotype analytics on Spark DataFrames."""
