"""memlake subpackage."""
