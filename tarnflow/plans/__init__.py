"""Plans over operators: declarative datasets, task graphs, governance, audit."""
