"""Operators put together: the facade, the test views and the registered queries."""
