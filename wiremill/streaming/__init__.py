"""wiremill.streaming"""
