"""Mountain geodata analytics as functions from DataFrame to DataFrame."""
