"""tidemark: analytics over activity and cost event logs, written as Spark plans."""
