"""The registered queries, each with its SQL for comparison."""
