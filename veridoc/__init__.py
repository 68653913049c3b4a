"""veridoc: evidence-backed knowledge graphs and corpus preparation as Spark programs."""
