"""Stage functions that chain operators, and parameter sweeps over them."""
