"""Configuration, staging of intermediate tables, and composed pipelines."""
