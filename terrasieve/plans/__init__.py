"""Building blocks shared by operators: scratch tables and exact global positions."""
