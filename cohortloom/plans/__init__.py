"""End-to-end jobs: cohort, tree inputs, features, model."""
