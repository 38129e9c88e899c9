"""Programs of image operations, random pipelines and the planner."""
