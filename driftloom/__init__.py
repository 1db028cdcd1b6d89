"""driftloom: provenance, fingerprints and incremental recomputation as Spark DataFrames."""
