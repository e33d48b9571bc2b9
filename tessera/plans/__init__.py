"""Query plans: the named queries over the tables, and the SQL each must agree with."""
