"""DataFrame operators of the inference pipeline."""
