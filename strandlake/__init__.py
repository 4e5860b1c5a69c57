"""strandlake: batch analytics over libraries of molecular trajectories, on PySpark."""
