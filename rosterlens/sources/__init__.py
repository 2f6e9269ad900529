"""Reading and writing tables, driver reports and fitted models."""
