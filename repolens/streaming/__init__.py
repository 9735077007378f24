"""Event, run and job state: batch folds of bounded tables and the same folds as live jobs."""
