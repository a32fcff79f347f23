"""Input folders of the tests."""
SF_SMALL = "/root/testdata/sf0.001"
