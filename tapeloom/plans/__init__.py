"""Plan helpers: staging between jobs, distributed prefix sums."""
