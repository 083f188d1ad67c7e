"""Column functions: spectral indices, scaling, terrain angles, feature names."""
