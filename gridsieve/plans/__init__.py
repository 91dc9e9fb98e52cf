"""End-to-end flows composed from the operators: curate and train, score, screen."""
