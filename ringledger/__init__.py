"""Ratings analytics on Spark: contest logs, rating folds, leaderboards and marts."""
