"""Detection over a landing directory."""
