"""The batch jobs, and the query catalogue with its SQL twins."""
