"""Multi-step plans: genetic search and batch experiments."""
