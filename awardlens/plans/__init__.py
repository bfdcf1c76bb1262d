"""Reports and jobs built from the functions and operators."""
