"""wiremill.operators"""
