"""Multi-step jobs: iterative restoration, tiled and batch runs."""
