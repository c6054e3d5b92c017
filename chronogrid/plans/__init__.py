"""Plans over operators: lineage, transform chains and the registered queries."""
