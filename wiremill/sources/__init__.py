"""wiremill.sources"""
