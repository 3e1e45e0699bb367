"""Ready queries over the driver's tables, and the façade over a user's own data."""
