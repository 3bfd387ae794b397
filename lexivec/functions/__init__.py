"""Column functions: expressions that a projection or filter can use."""
