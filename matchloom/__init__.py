"""matchloom: entity reconciliation over whole tables of queries, as Spark DataFrame programs."""
