"""The table store, and plans that chain operators over it."""
