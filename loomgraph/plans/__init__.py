"""Plans that run in rounds: each round is a DataFrame, stored before the next."""
