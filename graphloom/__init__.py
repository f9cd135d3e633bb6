"""graphloom: literature-graph analytics and training-table preparation as Spark jobs."""
