"""wiremill.functions"""
