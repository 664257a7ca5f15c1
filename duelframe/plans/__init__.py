"""Whole jobs, composed of operators. Tables in, tables out; paths live in `jobs`."""
