"""Session settings, report parameters, registered queries and their SQL twins."""
