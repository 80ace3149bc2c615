"""Fact-lake analytics on Spark: named DataFrame operators over typed facts about binaries."""
