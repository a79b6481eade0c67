"""Column-level building blocks. Nothing here triggers a job."""
