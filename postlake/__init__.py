"""postlake: labour-market posting analytics as PySpark DataFrame jobs."""
