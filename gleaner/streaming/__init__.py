"""Activity as a stream: the same aggregates as in gleaner.operators.evaluate, over windows with a watermark."""
