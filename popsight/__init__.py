"""popsight: profiling, cleaning, scoring-evaluation and segmentation operators
for survey-style population tables, as lazy Spark DataFrame functions."""

__version__ = "0.1.0"
