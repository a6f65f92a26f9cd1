"""lexloom: document analytics, clean-up and hybrid retrieval as Spark DataFrame programs."""
