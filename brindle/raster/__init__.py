"""NumPy kernels on grayscale rasters; operators call them by Arrow batches, one raster or group at a time."""
