"""Inventory-shaped raw tables over the generic test tables, the query registry and its SQL oracle."""
