"""Training-data operators.  Of the rest of siltstone they use ``shipping`` alone, and nothing else of
siltstone imports them."""
