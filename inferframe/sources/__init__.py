"""Where requests and servers come from."""
