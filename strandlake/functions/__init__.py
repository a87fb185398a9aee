"""Modification codes and statistical kernels."""
