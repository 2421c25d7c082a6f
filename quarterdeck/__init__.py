"""Company fundamentals on Spark: facts in, reconciled periods, scores, valuations and ranked tables out."""
