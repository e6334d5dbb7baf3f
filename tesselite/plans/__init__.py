"""Plan-time settings: grids, profiles and policies."""
