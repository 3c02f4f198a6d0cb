"""terravet: vetting of geographic change sets on Spark, and corpus preparation beside it."""
