"""factloom: data lineage held as Spark tables, lineage questions as DataFrame jobs."""
