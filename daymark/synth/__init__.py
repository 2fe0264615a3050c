"""A reproducible company / employee / department dataset of any size."""
