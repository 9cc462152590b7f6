"""Site-watch analytics on Spark: learned baselines, fused threat, one alert per object."""

__version__ = "0.1.0"
