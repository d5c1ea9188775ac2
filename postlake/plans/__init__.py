"""Views of the driver's tables in the mail shape, and the registered queries with their SQL."""
