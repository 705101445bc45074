"""Analytics operators: lazy DataFrame transformations."""
