"""Folders of the given tables (a module of its own: each folder of tests has its own conftest)."""

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
SF_LARGE = "/root/testdata/sf0.1"
