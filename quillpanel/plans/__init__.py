"""End-to-end plans: operators put together, and the registered queries."""
