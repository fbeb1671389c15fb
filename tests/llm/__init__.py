"""Tests of the training-data operators; a package, so that its conftest has a name of its own."""
