"""Jobs that combine several operators into one result or a bundle of results."""
