"""volumetry: cohort preparation, checking and scoring of sampled volumes on Spark."""
