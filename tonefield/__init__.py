"""Time-frequency analytics on Spark: signals, spectra, adaptive detection, clustering, reconstruction, evaluation."""
