"""skyloom: a Spark-first engine for multi-band sky-survey photometry and the
data work around it (catalogue search, image photometry, light curves, data
quality, regridding, compaction)."""

__version__ = "0.1.0"
