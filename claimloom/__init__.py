"""claimloom - claim analytics over short messages, expressed as Spark jobs."""

__version__ = "0.1.0"
